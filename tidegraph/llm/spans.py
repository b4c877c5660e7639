"""Long exact spans that stand verbatim in more than one text: repeated-phrase automata.

1. Winnowing takes phrases of PHRASE code points from every text such that any shared span of ``span`` or more holds a
   phrase that both texts yield. A phrase that two texts yield recurs.
2. Recurring phrases are confirmed passages. They are compiled into Aho-Corasick automata of bounded size, sharded by the
   text in which they stand first, so that a text's phrases fall into few shards. Every text is streamed through the
   automata that its fingerprints touch (no other can hold a span), which locates every occurrence of their phrases
   and keeps the text around it as far as a span needs it. Shards that very many texts touch are copied and split.
3. Occurrences of a phrase are compared by their surroundings. Phrases with few occurrences are compared directly, those
   with many through the classes of equal windows, so that rows never meet that share no whole span.

Texts that are equal throughout are represented by one of them until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.blocks import blocks
from tidegraph.llm.winnow import fingerprints, rolling
from tidegraph.plans.lineage import cut
from tidegraph.plans.skew import salted_join

SPAN = 256
PHRASE = 64
BLOCK = 2_000_000
#: Recurring phrases in one automaton, and code points of texts that one copy of it is streamed.
PHRASES, STREAM = 5_000, 16_000_000
#: Ids (of 8 bytes) that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Odd multipliers of the two rolling hashes of a window.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A phrase with more occurrences than this is compared through classes of equal windows.
MANY = 200


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and their numbers."""
    raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    return np.concatenate(raw) if raw else np.empty(0, np.uint32), np.array([len(r) for r in raw], np.int64)


def _phrases(span: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, BLOCK):
            codes, sizes = code_points([t or "" for t in texts])
            text, at, h = fingerprints(codes, sizes, phrase, span - phrase + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[text]), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "at", "phrase"])

    return run


def _passages(phrase: int):
    """(shard, phrase, text) of the recurring phrases that a text was chosen to lend its letters to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(o["shard"], o["phrase"], text[o["at"] : o["at"] + phrase]) for o in own]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            types = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "phrase", "text"])

    return run


def _locate(span: int, phrase: int):
    """Texts streamed through the automata of their shards. Rows come by shard and salt, passages before texts."""
    reach = span - phrase

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        names = ["phrase", "doc_id", "at", "before", "after"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

        def some(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        here, automaton, ready = None, None, False
        hold: list[tuple] = []
        for batch in batches:
            for shard, salt, name, doc, text in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if (shard, salt) != here:
                    here, automaton, ready = (shard, salt), ahocorasick.Automaton(), False
                if doc is None:
                    automaton.add_word(text, name)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if automaton.kind != ahocorasick.AHOCORASICK:
                    continue
                for end, p in automaton.iter(text):
                    a = end - phrase + 1
                    hold.append((p, doc, a, text[max(0, a - reach) : a], text[a : a + phrase + reach]))
                    if len(hold) >= 20_000:
                        yield some(hold)
                        hold = []
        yield some(hold)

    return run


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def _compare(span: int, phrase: int):
    def group(rows: list[tuple]) -> Iterator[tuple]:
        # Occurrences with equal surroundings behave alike, so one of them is compared for all.
        alike: dict[tuple[str, str], list[tuple]] = {}
        for r in rows:
            alike.setdefault((r[3], r[4]), []).append(r)
        kinds = [(b[::-1], a, of) for (b, a), of in alike.items()]
        for i, (b1, a1, of1) in enumerate(kinds):
            if len(of1) > 1 and len(b1) + len(a1) >= span:
                for x, r in enumerate(of1):
                    for s in of1[x + 1 :]:
                        if r[1] != s[1]:
                            yield r[1], s[1], r[2], s[2], len(b1), len(a1)
            for b2, a2, of2 in kinds[i + 1 :]:
                left, right = _common(b1, b2), _common(a1, a2)
                if right >= phrase and left + right >= span:
                    for r in of1:
                        for s in of2:
                            if r[1] != s[1]:
                                yield r[1], s[1], r[2], s[2], left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("phrase", "doc_id", "at", "before", "after")], strict=True)

        def groups():
            rows: list[tuple] = []
            for r in all_rows():
                if rows and rows[0][0] != r[0]:
                    yield rows
                    rows = []
                rows.append(r)
            if rows:
                yield rows

        hold: list[tuple] = []
        names = ["doc_id_a", "doc_id_b", "at_a", "at_b", "before", "after"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

        def batch():
            columns = list(zip(*hold, strict=True)) if hold else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for rows in groups():
            for a, b, x, y, left, right in group(rows):
                hold.append((a, b, x, y, left, right) if a < b else (b, a, y, x, left, right))
                if len(hold) >= 50_000:
                    yield batch()
                    hold = []
        yield batch()

    return run


def _windows(span: int, phrase: int):
    """Of each occurrence, a row for every window of ``span`` code points that holds the phrase: how far it reaches to the
    left, two rolling hashes of its text, and the code point before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                before = batch.column(3).to_pylist()
                n = np.array([len(b) for b in before], np.int64)
                codes, sizes = code_points([b + a for b, a in zip(before, batch.column(4).to_pylist(), strict=True)])
                least = np.maximum(0, span - (sizes - n))
                many = np.maximum(0, np.minimum(n, sizes) - least + 1)
                row = np.repeat(np.arange(len(n)), many)
                left = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[row]
                begin = n[row] - left
                place = (np.cumsum(sizes) - sizes)[row] + begin
                hashes = [rolling(codes, span, m)[place].view(np.int64) if len(place) else np.empty(0, np.int64) for m in MULTIPLIERS]
                prior = np.where(begin > 0, codes[np.maximum(place - 1, 0)].astype(np.int64), -1) if len(place) else np.empty(0, np.int64)
                kept = [batch.column(k).take(pa.array(row)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(left.astype(np.int32)), *map(pa.array, hashes), pa.array(prior.astype(np.int32))],
                    names=["phrase", "doc_id", "at", "left", "window", "window_2", "prior"],
                )

    return run


WINDOW_KEY = ["phrase", "left", "window", "window_2"]


class Shared:
    """Spans shared between texts of ``documents``; see the module. Null texts and null ids share nothing; rows that repeat
    an id with its text count once (of different texts under one id the smallest counts). Other columns are left out."""

    def __init__(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, phrase: int = PHRASE, many: int = MANY, phrases: int = PHRASES, stream: int = STREAM):
        self.span, self.phrase = span, phrase
        docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
        long = docs.filter(F.char_length("text") >= span)
        self.sizes = docs.select("doc_id", F.char_length("text").alias("n_chars"))
        digest = long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.char_length("text").alias("n_chars"))
        one = digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_chars").alias("n_chars"))
        several = one.filter("rep <> last").select("digest", "rep")
        #: (rep, doc_id) of the texts that occur more than once, the representative included.
        self.members = cut(salted_join(digest.select("digest", "doc_id"), several, ["digest"], "inner", F.col("doc_id")).select("rep", "doc_id").distinct())
        self.few = self.members.count() <= BROADCAST_IDS
        copies = self.members.filter("rep <> doc_id").select("doc_id")
        marks = long.mapInArrow(_phrases(span, phrase), "doc_id long, at int, phrase long")
        marks = cut(marks.join(copies, "doc_id", "left_anti"))
        # Of each recurring phrase the first occurrence, which names its shard: a text's phrases fall into few of these.
        again = marks.groupBy("phrase").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id <> last")
        again = cut(again.select("phrase", "first"))
        shards = -(-again.count() // phrases) or 1
        own = F.pmod(F.xxhash64("first.doc_id", F.floor(F.col("first.at") / BLOCK)), F.lit(shards)).alias("shard")
        places = salted_join(marks, again.select("phrase", "first", own), ["phrase"], "inner", F.col("doc_id"))
        mine = F.when((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.at") == F.col("at")), F.struct("shard", "phrase", "at"))
        touched = cut(places.groupBy("doc_id").agg(F.collect_list(mine).alias("own"), F.collect_set("shard").alias("shards")))
        # Texts without a recurring phrase share no span. While ids of the others are counted to be few, they are
        # broadcast, so that the scan leaves these texts out.
        if touched.count() <= BROADCAST_IDS:
            long = long.join(F.broadcast(touched.select("doc_id")), "doc_id", "left_semi")
        texts = cut(touched.join(long.groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id"))
        passages = texts.select("text", "own").mapInArrow(_passages(phrase), "shard long, phrase long, text string").dropDuplicates(["phrase"])
        streams = texts.select("doc_id", "text", F.explode("shards").alias("shard"))
        sizes = texts.select(F.char_length("text").alias("n"), F.explode("shards").alias("shard")).groupBy("shard").agg(F.sum("n").alias("n"))
        salts = cut(sizes.select("shard", (F.floor(F.col("n") / stream) + 1).alias("salts")))
        if shards <= BROADCAST_IDS:
            salts = F.broadcast(salts)
        passages = passages.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "phrase", F.lit(None).cast("long").alias("doc_id"), "text")
        streams = streams.join(salts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt"), F.lit(None).cast("long").alias("phrase"), "doc_id", "text")
        rows = passages.union(streams).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("doc_id").asc_nulls_first())
        self.occurrences = cut(rows.mapInArrow(_locate(span, phrase), "phrase long, doc_id long, at int, before string, after string"))
        counts = self.occurrences.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
        hot = cut(counts.filter(F.col("n") > many).select("phrase"))
        #: Whether any phrase is compared through classes of windows.
        self.hot = not hot.isEmpty()
        cold = self.occurrences.join(hot, "phrase", "left_anti") if self.hot else self.occurrences
        cold = cold.repartition("phrase").sortWithinPartitions("phrase", "doc_id")
        kept = "doc_id_a long, doc_id_b long, at_a int, at_b int, before int, after int"
        self.matches = cut(cold.mapInArrow(_compare(span, phrase), kept))
        hot_rows = self.occurrences.join(hot, "phrase", "left_semi")
        windows = hot_rows.mapInArrow(_windows(span, phrase), "phrase long, doc_id long, at int, left int, window long, window_2 long, prior int")
        self.windows = cut(windows) if self.hot else windows

    def links(self) -> DataFrame:
        """(a, b), a < b: each pair of different texts that share a span, every text by its representative."""
        cold = self.matches.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        if not self.hot:
            return cold.distinct()
        a = self.windows.select(*WINDOW_KEY, F.col("doc_id").alias("a"), F.col("prior").alias("pa"))
        b = self.windows.select(*WINDOW_KEY, F.col("doc_id").alias("b"), F.col("prior").alias("pb"))
        whole = self.span - self.phrase
        first = (F.col("left") == whole) | (F.col("pa") != F.col("pb")) | ((F.col("pa") == -1) & (F.col("pb") == -1))
        met = salted_join(a, b, WINDOW_KEY, "inner", F.col("a")).filter("a < b").filter(first)
        return cold.union(met.select("a", "b")).distinct()

    def _with_copies(self, rows: DataFrame, key: str, name: str, how: str, spread: Column) -> DataFrame:
        """``rows`` with a row for each text (``name``) equal to the representative ``key``."""
        copies = self.members.select(F.col("rep").alias(key), F.col("doc_id").alias(name))
        if self.few:  # counted
            return rows.join(F.broadcast(copies), key, how)
        return salted_join(cut(rows), copies, [key], how, spread)

    def linked(self) -> DataFrame:
        """(doc_id, class_id, n_links) of every text: the smallest id of the texts equal to it, and how many different
        other texts share a span with it. Linear in links between different texts; copies are not paired."""
        links = cut(self.links())
        both = links.select(F.col("a").alias("class_id"), "b").union(links.select(F.col("b").alias("class_id"), "a"))
        counts = both.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        ids = self.sizes.select("doc_id").distinct().join(self.members, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))
        out = salted_join(cut(ids), counts, ["class_id"], "left", F.col("doc_id"))
        return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), each pair of texts that share a span: ``links`` with their copies, and copies themselves.
        Texts with very many copies are split over tasks; the rows are as many as the pairs."""
        wide = self._with_copies(self.links(), "a", "xa", "left", F.col("b"))
        wide = self._with_copies(wide, "b", "xb", "left", F.struct("a", "xa")).select(F.coalesce("xa", "a").alias("x"), F.coalesce("xb", "b").alias("y"))
        within = self._with_copies(self.members.select("rep", F.col("doc_id").alias("x")), "rep", "y", "inner", F.col("x"))
        both = wide.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).union(within.filter("x < y").select("x", "y"))
        return both.select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))

    def shares(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, shared_share): how much of each text lies in spans that another text holds too."""
        m = self.matches
        side = lambda s: m.select(F.col(f"doc_id_{s}").alias("doc_id"), (F.col(f"at_{s}") - F.col("before")).alias("b"), (F.col(f"at_{s}") + F.col("after")).alias("e"))
        key = WINDOW_KEY
        spans = side("a").union(side("b"))
        classes = self.windows.groupBy(*key).agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x <> y").select(*key)
        hot = salted_join(self.windows, classes, key, "left_semi", F.col("doc_id"))
        hot = hot.select("doc_id", (F.col("at") - F.col("left")).alias("b"), (F.col("at") - F.col("left") + self.span).alias("e"))
        spans = (spans.union(hot) if self.hot else spans).distinct()
        w = Window.partitionBy("doc_id").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.max("e").over(w), F.lit(0))
        covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("b"), before))).groupBy("doc_id").agg(F.sum("new").alias("c"))
        out = self.sizes.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
        copies = self.members.select("doc_id", F.lit(True).alias("copy"))
        out = out.join(covered, "doc_id", "left").join(copies, "doc_id", "left")
        shared = F.when(F.col("copy"), F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).cast("long")
        out = out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"))
        share = F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 9)).otherwise(F.lit(0.0))
        return out.withColumn("shared_share", share)
