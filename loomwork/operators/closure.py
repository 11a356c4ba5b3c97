"""Fix points over relation tables: closures, equivalences and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.staging import stage


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """(src, dst, depth): all pairs joined by a directed path, with the least number of steps."""
    base = stage(edges.filter(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "base")
    known = base.withColumn("depth", F.lit(1))
    front, depth = known, 1
    while depth < rounds and not front.isEmpty():
        depth += 1
        step = front.select("src", F.col("dst").alias("via")).join(base.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        front = stage(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        known = stage(known.unionByName(front), "known")
    return known


def reason(facts: DataFrame, rounds: int = 32) -> DataFrame:
    """(relation, src, dst, rule) inferred from facts (relation, src, dst) until nothing is new.

    broader and subClassOf are transitive; exactMatch is symmetric and transitive; an
    equivalentClass is a subclass both ways, and mutual subclasses are equivalent;
    disjointWith holds for subclasses of either side.
    """
    known = stage(facts.select("relation", "src", "dst").distinct().withColumn("rule", F.lit("asserted")), "facts")
    of = lambda df, name: df.filter(F.col("relation") == name).select("src", "dst")
    for _ in range(rounds):
        new = []

        def add(relation: str, rows: DataFrame, rule: str, new=new) -> None:
            new.append(rows.select(F.lit(relation).alias("relation"), "src", "dst", F.lit(rule).alias("rule")))

        for relation, rule in (("broader", "broader-transitive"), ("subClassOf", "subclass-transitive"), ("exactMatch", "match-transitive")):
            a = of(known, relation)
            add(relation, a.withColumnRenamed("dst", "via").join(a.withColumnRenamed("src", "via"), "via").select("src", "dst"), rule)
        for relation in ("exactMatch", "equivalentClass", "disjointWith"):
            add(relation, of(known, relation).select(F.col("dst").alias("src"), F.col("src").alias("dst")), "symmetric")
        add("subClassOf", of(known, "equivalentClass"), "equivalent-is-subclass")
        sub = of(known, "subClassOf")
        add("equivalentClass", sub.join(sub.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]), "mutual-subclass")
        add("disjointWith", sub.withColumnRenamed("dst", "via").join(of(known, "disjointWith").withColumnRenamed("src", "via"), "via").select("src", "dst"), "disjoint-down")
        made = new[0]
        for rows in new[1:]:
            made = made.unionByName(rows)
        made = made.filter("src <> dst").groupBy("relation", "src", "dst").agg(F.min("rule").alias("rule"))
        fresh = stage(made.join(known, ["relation", "src", "dst"], "left_anti").select("relation", "src", "dst", "rule"), "facts")
        if fresh.isEmpty():
            break
        known = stage(known.unionByName(fresh), "facts")
    return known


def conflicts(known: DataFrame) -> DataFrame:
    """Classes that are both a subclass of and disjoint with another."""
    a = known.filter("relation = 'subClassOf'").select("src", "dst")
    return a.join(known.filter("relation = 'disjointWith'").select("src", "dst"), ["src", "dst"])
