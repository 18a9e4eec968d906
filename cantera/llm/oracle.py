"""SQL equivalent to the llm queries where SQL can express them."""

from __future__ import annotations

import re
import unicodedata


def _char_map() -> str:
    """A map literal from each non-ASCII character to what is left of it as a term: its compatibility decomposition without marks, in lower case."""
    keys, values = [], []
    for c in map(chr, range(0x80, 0x110000)):
        if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) != "Cn":
            kept = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M").lower()
            kept = re.sub("[^a-z0-9]", " ", kept)
            if kept.strip():
                keys.append(c)
                values.append(kept)
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"map({quoted(keys)}, {quoted(values)})"


def _terms(column: str) -> str:
    """SQL for the list of a text's terms, given a one-row relation m with the map mm."""
    chars = f"regexp_extract_all(regexp_replace({column}, '\\p{{M}}', '', 'g'), '(?s).')"
    mapped = f"list_transform({chars}, lambda c: CASE WHEN unicode(c) < 128 THEN lower(c) ELSE coalesce(mm[c], ' ') END)"
    return f"regexp_extract_all(array_to_string({mapped}, ''), '[a-z0-9]+')"


def songs() -> str:
    """Relations r(id, st, tt): each song's terms of the title (null if there is none) and of the text."""
    return f"m AS (SELECT {_char_map()} AS mm), s0 AS (SELECT id, any_value(song) AS song, any_value(texto) AS texto FROM canciones WHERE id IS NOT NULL GROUP BY id), r AS MATERIALIZED (SELECT id, {_terms('song')} AS st, {_terms('texto')} AS tt FROM s0, m)"


def _runs() -> str:
    """songs() and g(id, run), n(id, n): the distinct runs of each record with enough terms, and how many."""
    return f"""{songs()}, c AS (SELECT id, CASE WHEN st IS NULL THEN tt ELSE list_concat(st, tt) END AS w FROM r WHERE len(tt) >= 10),
p AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c), g AS MATERIALIZED (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM p),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id)"""


def _near_duplicates() -> str:
    return f"""WITH {_runs()}, shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.run = b.run AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM shared JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * k >= x.n + y.n - k"""


def _classes() -> str:
    return f"""WITH {_runs()}, sig AS (SELECT id, string_agg(run, '|' ORDER BY run) AS s FROM g GROUP BY id), cls AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM sig),
h AS MATERIALIZED (SELECT g.id, run FROM g JOIN cls USING (id) WHERE id = class_id), shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM h a JOIN h b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
linked AS (SELECT id_a, id_b FROM shared JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * k >= x.n + y.n - k), degree AS (SELECT c, count(*) AS n FROM (SELECT id_a AS c FROM linked UNION ALL SELECT id_b FROM linked) GROUP BY c)
SELECT CAST(cls.id AS BIGINT) AS id, CAST(class_id AS BIGINT) AS class_id, count(*) OVER (PARTITION BY class_id) AS n_copies, coalesce(degree.n, 0) AS n_links FROM cls LEFT JOIN degree ON c = class_id"""


def _frequency(select: str) -> str:
    return f"""WITH {songs()}, t AS (SELECT id, unnest(tt) AS term FROM r), f AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM t GROUP BY term),
n AS (SELECT count(DISTINCT id) AS n FROM t), marked AS (SELECT term, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * n THEN 'common' ELSE 'useful' END AS mark FROM f, n) {select}"""


def _distinctive() -> str:
    return f"""WITH {songs()}, t AS (SELECT id, unnest(tt) AS term FROM r), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(DISTINCT id) AS n FROM t), s AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) DESC, term) AS k FROM tf JOIN df USING (term), n)
SELECT id, term FROM s WHERE k <= 3"""


def _enriched() -> str:
    choose = "lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0)".format
    term = f"exp({choose('big', 'k')} + {choose('(m - big)', '(n - k)')} - ({choose('m', 'n')}))"
    return f"""WITH {songs()}, t AS (SELECT id, unnest(tt) AS term FROM r), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), k AS (SELECT term, count(*) AS df, sum(tf) AS big FROM tf GROUP BY term),
l AS (SELECT id, sum(tf) AS n, count(*) AS tests FROM tf GROUP BY id), mt AS (SELECT sum(tf) AS m FROM tf),
x0 AS (SELECT id, term, tf, df, tests, CAST(big AS DOUBLE) AS big, CAST(n AS DOUBLE) AS n, CAST(mt.m AS DOUBLE) AS m FROM tf JOIN k USING (term) JOIN l USING (id), mt),
x AS (SELECT id, term, tf, df, tests, ln(least(1.0, list_sum([{term} FOR k IN range(tf, CAST(least(big, n) AS BIGINT) + 1)]))) AS p FROM x0),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, term) AS place FROM x), a AS (SELECT *, p + ln(tests) - ln(place) AS raw FROM o),
s AS (SELECT *, greatest(0.0, -min(raw) OVER (PARTITION BY id ORDER BY place DESC ROWS UNBOUNDED PRECEDING) / ln(10.0)) AS score FROM a), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, raw, term) AS rank FROM s)
SELECT id, term, CAST(tf AS INT) AS tf, df, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM q WHERE rank <= 3 AND score >= -log10(0.05)"""


def _reading() -> str:
    return r"""WITH t AS (SELECT doc_id, nfc_normalize(any_value(text)) AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(t, '\p{L}+') AS w, list_filter(string_split_regex(t, '[\n\r]+|[.!?…]+(?:[ \t\n\r]|\z)'), lambda p: regexp_matches(p, '\p{L}')) AS s FROM t),
v AS (SELECT doc_id, round(CAST(len(w) AS DOUBLE) / len(s) + 100.0 * len(list_filter(w, lambda x: length(x) > 6)) / len(w), 6) AS v FROM w WHERE len(w) >= 30)
SELECT doc_id, CAST(1 + (v >= 18)::INT + (v >= 28)::INT + (v >= 42)::INT + (v >= 58)::INT AS INT) AS nivel FROM v"""


def _similar(extractor: str, name: str, column: str, dim: int) -> str:
    good = f"len({column}) = {dim} AND len(list_filter({column}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({column}, lambda x: x <> 0)) > 0"
    return f"""SELECT '{extractor}' AS extractor, a AS vec_a, b AS vec_b FROM (
WITH v0 AS (SELECT vec_id AS id, any_value(CAST({column} AS DOUBLE[])) AS v FROM {name} WHERE vec_id IS NOT NULL AND {good} GROUP BY vec_id),
v AS MATERIALIZED (SELECT id, v, list_dot_product(v, v) AS n FROM v0), p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, round(list_dot_product(x.v, y.v) / sqrt(x.n * y.n), 12) AS c FROM v x, v y WHERE x.id <> y.id AND list_dot_product(x.v, y.v) / sqrt(x.n * y.n) >= 0.9959),
k AS MATERIALIZED (SELECT a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p) WHERE k <= 10 AND c >= 0.996)
SELECT x.a, x.b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)"""


def sql(vectors) -> dict[str, str]:
    return {
        "p1_found": " UNION ALL ".join(_similar(*v) for v in vectors),
        "p2_found": _near_duplicates(),
        "p2_classes": _classes(),
        "p3_found": _frequency("SELECT term, mark FROM marked WHERE mark <> 'useful'"),
        "p3_terms": _frequency("SELECT * FROM marked"),
        "p6_found": _distinctive(),
        "p6_enriched": _enriched(),
        "p9_found": _reading(),
    }
