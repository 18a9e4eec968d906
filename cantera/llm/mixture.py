"""Mixing sources to target weights by hierarchical budgeting (problem 8).

The budget runs down a tree domain - language - source. A leaf's weight is its source's target share times the
language's part of that source, a node's the sum below it. At each node the budget is split by weight;
what a child cannot take, as its documents may be repeated only so often, goes to its siblings by their weights, and only
what a whole node cannot take reaches the siblings of its ancestors. A leaf then takes whole epochs of its
documents and, of the next epoch, the prefix in that epoch's seeded order that its budget still covers: the last document
is in when more than half of it is.

The prefix is found without sorting a leaf: its documents fall into SLICES slices of the hash that orders
them; sums per slice tell in which slice the prefix ends, and only that slice is put in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.llm.tokens import TOKENIZERS, token_count
from cantera.session import fan_out, written

SLICES = 4096
#: Leaves that may reach the driver: targets times languages. More are an error.
MOST_LEAVES = 100_000


@dataclass
class Node:
    """A node of the tree: leaves have a weight and a capacity of their own, other nodes those of their children together."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)

    def child(self, name: str) -> "Node":
        return self.children.setdefault(name, Node())

    def total(self) -> None:
        for c in self.children.values():
            c.total()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())


def split(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """The budget by weight; what exceeds a capacity goes to the others by weight, until all is placed or nobody has room."""
    given = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    left = min(budget, sum(capacities[i] for i in open_))
    while open_ and left > 1e-9:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * share >= capacities[i] - given[i]]
        if not full:
            for i in open_:
                given[i] += weights[i] * share
            break
        for i in full:
            left -= capacities[i] - given[i]
            given[i] = capacities[i]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def allocate(node: Node, budget: float, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
    if not node.children:
        return {path: min(budget, node.capacity)}
    names = list(node.children)
    given = split(budget, [node.children[n].weight for n in names], [node.children[n].capacity for n in names])
    return {leaf: b for n, g in zip(names, given) for leaf, b in allocate(node.children[n], g, (*path, n)).items()}


def language(column) -> F.Column:
    """A language tag without region and case; 'und' for none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.trim(column), "^[A-Za-z]+", 0)), F.lit("")), F.lit("und"))


def mix(
    df: DataFrame, targets: DataFrame, domains: dict[str, str], total_tokens: float | str | None = None, seed: int = 11, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, lang, n_tokens, uses) and the report (source, cuota, n_docs, n_tokens, share, most_uses).

    df has doc_id, text, lang and source; targets has source, cuota and max_repeticiones. domains names each source's domain, others are in
    'general'. total_tokens is the size wanted, 'all' for the tokens of all documents with a target; by default the largest at which no source with documents falls short of its share, those
    without documents set aside. With a size wanted, what a source lacks goes to its siblings first; cuota and share then tell wanted from reached. Documents without tokens (null and empty texts), of null sources or of sources without target are not used; repeated rows count
    once; null keys, targets with a null source, a share or a number of repetitions that is null or not positive are left out; of several targets of one source the largest share counts.
    A target without documents is reported with 0. Empty tables give an empty mixture."""
    spark = df.sparkSession
    wanted = targets.filter("source is not null and cuota > 0 and max_repeticiones > 0").groupBy("source").agg(F.max_by("cuota", F.struct("cuota", "max_repeticiones")).cast("double").alias("cuota"), F.max_by("max_repeticiones", F.struct("cuota", "max_repeticiones")).cast("int").alias("max_repeticiones"))
    wanted = written(wanted)
    rows = df.filter("doc_id is not null").join(wanted.select("source"), "source", "left_semi")
    sized = rows.select("doc_id", "source", language(F.col("lang")).alias("lang"), token_count(F.col("text"), tokenizer, folder).alias("n_tokens"))
    docs = written(sized.filter("n_tokens > 0").repartition(fan_out(df), "doc_id").dropDuplicates(["doc_id"]))

    leaves = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    goals = wanted.limit(MOST_LEAVES + 1).collect()
    if max(len(leaves), len(goals)) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} sources and languages")
    tokens: dict[str, int] = {}
    for r in leaves:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["tokens"]
    share = {r["source"]: r["cuota"] for r in goals}
    repeats = {r["source"]: r["max_repeticiones"] for r in goals}
    root = Node()
    for r in sorted(leaves, key=lambda r: (r["source"], r["lang"])):
        leaf = root.child(domains.get(r["source"], "general")).child(r["lang"]).child(r["source"])
        leaf.weight, leaf.capacity = share[r["source"]] * r["tokens"] / tokens[r["source"]], float(repeats[r["source"]] * r["tokens"])
    for s in sorted(set(share) - set(tokens)):
        root.child(domains.get(s, "general")).child("und").child(s).weight = share[s]
    root.total()
    if total_tokens == "all":
        total_tokens = float(sum(tokens.values()))
    elif total_tokens is None:
        present = sum(share[s] for s in tokens)
        total_tokens = min((repeats[s] * tokens[s] * present / share[s] for s in tokens), default=0.0)
        for s in set(share) - set(tokens):  # what they cannot take would burden their siblings alone
            root.child(domains.get(s, "general")).child("und").child(s).weight = 0.0
        root.total()
    of = {(r["source"], r["lang"]): r["tokens"] for r in leaves}
    plan = []
    for (_, lang, source), budget in allocate(root, total_tokens).items() if root.children else []:
        if (source, lang) in of:
            size = of[source, lang]
            whole = int(min(repeats[source], (budget + 1e-6) // size))
            plan.append((source, lang, whole, float(budget - whole * size)))
    plan_df = spark.createDataFrame(plan, "source string, lang string, whole int, rest double")  # a row per leaf

    turn = F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))
    ordered = docs.join(F.broadcast(plan_df), ["source", "lang"]).withColumn("turn", turn).withColumn("slice", F.pmod("turn", F.lit(SLICES)).cast("int"))
    sums = ordered.groupBy("source", "lang", "slice").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).filter("before <= rest")
    last = ends.groupBy("source", "lang").agg(F.max("slice").alias("last"), F.max_by("before", "slice").alias("before"))  # a row per leaf
    placed = ordered.join(F.broadcast(last), ["source", "lang"], "left")
    inner = Window.partitionBy("source", "lang").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter("slice = last").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    other = placed.filter("last is null or slice <> last").withColumn("extra", F.coalesce((F.col("slice") < F.col("last")).cast("int"), F.lit(0)))
    keep = ["doc_id", "source", "lang", "n_tokens", (F.col("whole") + F.col("extra")).alias("uses")]
    mixture = edge.select(*keep).unionByName(other.select(*keep)).filter("uses > 0")

    used = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    every = used.agg(F.sum("n_tokens").alias("every"))  # one row
    report = wanted.join(F.broadcast(used), "source", "left").join(F.broadcast(every)).fillna(0, ["n_docs", "n_tokens", "most_uses"])
    return mixture, report.select("source", "cuota", "n_docs", "n_tokens", F.round(F.coalesce(F.col("n_tokens") / F.col("every"), F.lit(0.0)), 6).alias("share"), "most_uses")
