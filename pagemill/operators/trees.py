"""Extraction trees as rows: duplicates, budgets, roll-ups, output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mark_duplicates(nodes: DataFrame, group: str, order: str, content: str, key: str) -> DataFrame:
    """nodes with fingerprint and repeated: whether the same bytes came before in the group, in the order; null content has neither."""
    seen = W.partitionBy(group, "fingerprint").orderBy(order, key)
    marked = nodes.withColumn("fingerprint", F.sha2(content, 256))
    return marked.withColumn("repeated", F.when(F.col("fingerprint").isNotNull(), F.row_number().over(seen) > 1))


def admit(children: DataFrame, group: str, order: str, size: str, key: str, max_files: int | None, max_bytes: int | None, largest: int = 128 << 20) -> DataFrame:
    """(group, key, order, outcome) under a budget shared by the children of a group: 'accepted', 'refused' or 'stopped'.

    Before each child the budget is looked at: without slots or bytes left the
    walk stops, and what follows is 'stopped'. A child larger than the bytes
    left, or than ``largest``, or of unknown size, is refused and costs a slot only;
    others cost a slot and their bytes. Refusals do not spend bytes, so no running sum tells; the fold runs over
    the children of one container.
    """
    items = children.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(size).cast("bigint").alias("s")))).alias("c"))
    state = "struct<slots:bigint,bytes:bigint,stopped:boolean,out:array<string>>"
    many = 1 << 62

    def add(acc: Column, x: Column) -> Column:
        stop = acc["stopped"] | (acc["slots"] <= 0) | (acc["bytes"] <= 0)
        fits = x["s"].isNotNull() & (x["s"] <= F.least(acc["bytes"], F.lit(largest).cast("bigint")))
        return F.struct(
            F.when(stop, acc["slots"]).otherwise(acc["slots"] - 1).alias("slots"), F.when(~stop & fits, acc["bytes"] - x["s"]).otherwise(acc["bytes"]).alias("bytes"), stop.alias("stopped"),
            F.concat(acc["out"], F.array(F.when(stop, "stopped").when(fits, "accepted").otherwise("refused"))).alias("out"),
        ).cast(state)

    start = F.struct(F.lit(many if max_files is None else max_files).alias("slots"), F.lit(many if max_bytes is None else max_bytes).alias("bytes"), F.lit(False).alias("stopped"), F.array().alias("out")).cast(state)
    told = items.select(group, "c", F.aggregate("c", start, add, lambda acc: acc["out"]).alias("out"))
    return told.select(group, F.explode(F.arrays_zip("c", "out")).alias("z")).select(group, F.col("z.c.k").alias(key), F.col("z.c.o").alias(order), F.col("z.out").alias("outcome"))


def all_text(nodes: DataFrame, root: str, path: str, text: str) -> DataFrame:
    """(root, text): texts of a tree in pre-order (path is an array that sorts so), trimmed, by blank lines; empty ones are left out."""
    from pagemill.functions.text import trim_space

    rows = nodes.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.groupBy(root).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), trim_space(text).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def print_tree(nodes: DataFrame, root: str, path: str, depth: str, label: Column) -> DataFrame:
    """(root, tree): one line a node in pre-order, two spaces a level."""
    line = F.concat(F.repeat(F.lit("  "), F.col(depth)), label)
    return nodes.groupBy(root).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("tree"))


def plan_outputs(files: DataFrame, key: str, path: str, suffix: str) -> DataFrame:
    """(key, output): the path with a suffix in place of its extension; where several paths of a folder share a stem, each keeps its extension; paths that are still the same get -2, -3 by order of key, passing over names that another path has of itself."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    rows = files.where(F.col(path).isNotNull()).select(key, path, stem.alias("stem"))
    crowd = F.count("*").over(W.partitionBy("stem"))
    named = rows.select(key, F.when(crowd > 1, F.col(path)).otherwise(F.col("stem")).alias("base"))
    n = F.row_number().over(W.partitionBy("base").orderBy(key))
    numbered = named.withColumn("n", n)
    ends = named.select(F.regexp_extract("base", r"^(.*)-[1-9][0-9]{0,8}$", 1).alias("base"), F.regexp_extract("base", r"-([1-9][0-9]{0,8})$", 1).try_cast("int").alias("taken")).where("taken is not null")
    taken = ends.join(numbered.where("n = 2").select("base"), "base", "left_semi").groupBy("base").agg(F.collect_set("taken").alias("taken"))
    some = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(2), F.col("n") + F.size(some)), some)
    out = numbered.join(taken, "base", "left")
    return out.select(key, F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.try_element_at(free, F.col("n") - 1).cast("string"))).otherwise(""), F.lit(suffix)).alias("output"))


def page_list(spec: Column, count: Column) -> Column:
    """Zero-based pages of a specification such as "2,5-9,1" in the order written, each once, cut at the page count; null for a malformed one.

    Parts are separated by commas, blank ones skipped. "0", "3-1", "-2" and words are malformed, whatever the count.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    ok = F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,9}(\s*-\s*[0-9]{1,9})?$"))

    def ends(p: Column) -> Column:
        a = F.regexp_extract(p, "^([0-9]+)", 1).try_cast("bigint")
        b = F.regexp_extract(p, r"-\s*([0-9]+)$", 1)
        return F.struct(a.alias("a"), F.when(b != "", b.try_cast("bigint")).otherwise(a).alias("b"))

    spans = F.transform(parts, ends)
    ok_ends = F.forall(spans, lambda s: (s["a"] >= 1) & (s["b"] >= s["a"]))
    inside = F.filter(spans, lambda s: s["a"] <= count)
    pages = F.array_distinct(F.flatten(F.transform(inside, lambda s: F.sequence(s["a"] - 1, F.least(s["b"], count.cast("bigint")) - 1))))
    return F.when(ok & F.coalesce(ok_ends, F.lit(False)), F.transform(pages, lambda p: p.cast("int")))
