"""Line and token dictionaries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import lines_of, words_of
from tidegraph.operators.wave import ranked


def lines(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line): lines with their ends; texts with a NUL are left out, null ones have no lines."""
    ok = files.filter(F.col(text).isNotNull() & ~F.contains(F.col(text), F.lit("\x00")))
    return ok.select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def dictionary(rows: DataFrame, item: str, least: int = 2, min_bytes: int = 0) -> DataFrame:
    """(item, n, rule_id): items that occur ``least`` times or more, numbered from 0 by count descending, then by hash and
    item. Counts combine on the map side; numbers come from a range sort."""
    counts = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.octet_length(item) >= min_bytes))
    out = ranked(counts.withColumn("__h", F.sha2(item, 256)), [F.col("n").desc(), F.col("__h"), F.col(item)], None)
    return out.select(item, "n", (F.col("rank") - 1).alias("rule_id"))


def encode(rows: DataFrame, rules: DataFrame, item: str = "line") -> DataFrame:
    """Rows with rule_id where the item has one, else ``residual``: the item itself. Frequent items are what the dictionary
    holds, so their join is split."""
    from tidegraph.plans.skew import salted_join

    spread = F.struct(*[c for c in rows.columns if c != item])
    out = salted_join(rows, rules.select(item, "rule_id"), [item], "left", spread)
    return out.withColumn("residual", F.when(F.col("rule_id").isNull(), F.col(item))).drop(item)


def rebuild(encoded: DataFrame, rules: DataFrame, key: str = "doc_id", item: str = "line") -> DataFrame:
    """(key, text) put together again from lines by rule or residual, in order. A text must fit a row, as it did before."""
    from tidegraph.plans.skew import salted_join

    out = salted_join(encoded, rules.select("rule_id", item), ["rule_id"], "left", F.struct(key, "line_no"))
    rows = out.select(key, "line_no", F.coalesce(F.col(item), F.col("residual")).alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("text"))


def phrase_gains(files: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 5, keep: int = 512) -> DataFrame:
    """(phrase, n, gain, rank): phrases of 1 to ``longest`` tokens by what a dictionary saves, gain = n (bytes - 2) - (bytes
    + 4), where positive; the first ``keep`` by gain, then count, then phrase."""
    toks = files.filter(F.col(text).isNotNull()).select(F.col(key), words_of(F.col(text)).alias("w"))
    size = F.size("w")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice("w", i + 1, n), ""))).otherwise(F.array().cast("array<string>"))))
    counts = toks.select(F.explode(grams).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    b = F.octet_length("phrase").cast("long")
    rows = counts.withColumn("gain", F.col("n") * (b - 2) - (b + 4)).filter("gain > 0 AND n > 1")
    return ranked(rows, [F.col("gain").desc(), F.col("n").desc(), F.col("phrase")], keep)


def pack_sizes(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mode, bytes): what a text takes raw, with an index of lines, and with repeated lines stored once."""
    raw = files.filter(F.col(text).isNotNull()).select(key, F.octet_length(text).cast("long").alias("raw"))
    rows = lines(files, key, text).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    b = F.octet_length("line").cast("long")
    per = rows.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= 2, b + 4 + 2 * F.col("n")).otherwise(b + 3)).alias("family"))
    both = raw.join(per, key, "left")
    modes = F.array(
        F.struct(F.lit("RAW").alias("mode"), F.col("raw").alias("bytes")),
        F.struct(F.lit("RAW_INDEX").alias("mode"), (F.col("raw") + 4 * F.coalesce("n", F.lit(0)) + 8).alias("bytes")),
        F.struct(F.lit("LINE_FAMILY").alias("mode"), (F.coalesce("family", F.lit(0)) + 16).alias("bytes")),
    )
    return both.select(key, F.explode(modes).alias("m")).select(key, "m.*")


def greedy(texts: DataFrame, phrases: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, codes): texts encoded by the longest phrase at each place (its index), else by one code point (-1 - its code).

    ``phrases`` is a dictionary of bounded size (see ``phrase_gains``); longest match is sequential within a text.
    """
    import pandas as pd

    longest = max(map(len, phrases), default=0)
    index = {p: i for i, p in reversed(list(enumerate(phrases)))}

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf[text]:
                codes, i, n = [], 0, len(t or "")
                while i < n:
                    size = next((k for k in range(min(longest, n - i), 0, -1) if t[i : i + k] in index), 0)
                    codes.append(index[t[i : i + size]] if size else -1 - ord(t[i]))
                    i += size or 1
                out.append(codes)
            yield pd.DataFrame({key: pdf[key], "codes": out})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, codes array<int>")


def ungreedy(encoded: DataFrame, phrases: list[str], key: str = "doc_id") -> DataFrame:
    """(key, text) back from codes."""
    words = F.array(*[F.lit(p) for p in phrases]) if phrases else F.array().cast("array<string>")
    piece = F.transform("codes", lambda c: F.when(c >= 0, F.get(words, c)).otherwise(F.decode(F.unhex(F.lpad(F.hex(-1 - c), 8, "0")), "utf-32")))
    return encoded.select(key, F.array_join(piece, "").alias("text"))


def first_lines(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` lines of each text."""
    w = Window.partitionBy(key).orderBy("line_no")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
