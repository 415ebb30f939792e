"""Spelling variants by permuterm rotations.

Every frequent word, marked with a terminator, gives all its rotations.  Two words that differ
by a replaced character have rotations that agree in all but the last character; where a
character was inserted, the longer word's rotation without its last character is a rotation of
the shorter word.  So each rotation is sorted once whole and once without its last character,
the edited one: near words then stand side by side under one key.  A key has at most one whole
word and one shortened one for each letter, so groups are small whatever the words are, and a
scan gives every member its number of near words and the best of them, never all pairs.

Rotations of a word take the square of its length, so words over ``LONG`` code points use a
rolling hash of the word with a gap instead (linear), and their pairs are compared in full."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank, written

MARK = "$"  # stands in no word, before every letter
LONG = 64
PRIME, BASE, GAP = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835, 1  # of the rolling hash; no letter is code 1
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, edit_every: int = 199, held: int = 200_000) -> DataFrame:
    """(word, n): runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, only A-Z
    lower-cased, that have ``least_length`` code points and occur ``least_count`` times.  Where
    ``edit_every`` divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code point
    number h modulo its length.  Words are counted in the task before they are shuffled; a task
    holds about ``held`` of them at a time.  A null text has no words, a null id is empty."""
    def run(batches):
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}").findall
        counts: Counter = Counter()

        def out():
            some = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return some
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for word, n in Counter(runs(text.as_py())).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    h = zlib.crc32(word.encode(), start)
                    if h % edit_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= held:
                    yield out()
        yield out()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), blank("text").alias("text"))
    found = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, word, n): every rotation whole (nothing skipped), and every rotation that
    ends in a letter without it (the letter is skipped)."""
    marked = F.concat("word", F.lit(MARK))
    turned = words.withColumn("marked", marked).select(
        "word", "n", F.explode(F.expr("transform(sequence(0, length(word)), i -> concat(substr(marked, i + 1), substr(marked, 1, i)))")).alias("turned"))
    both = F.array(F.struct(F.col("turned").alias("key"), F.lit("").alias("skipped")),
                   F.struct(F.expr("left(turned, length(turned) - 1)").alias("key"), F.expr("right(turned, 1)").alias("skipped")))
    return turned.select("word", "n", F.explode(both).alias("x")).select("x.key", "x.skipped", "word", "n").where(F.col("skipped") != MARK)


def _candidate(word: Column, n: Column) -> Column:
    """The smallest is the best: largest n, then the first word in code-point order."""
    return F.struct((-n).alias("minus_n"), word.alias("word"))


def _scan(rows: DataFrame) -> DataFrame:
    """(word, found, best) of every row that has near words under its key.

    Of words that differ by an insertion into a run of one letter, several keys agree; only the
    one where the skipped letter is unlike the letter before it (the end of the key) counts."""
    group = Window.partitionBy("key")
    order = group.orderBy(F.col("skipped") == "", F.desc("n"), "word")  # shortened rows first, best first
    short, this = F.col("skipped") != "", _candidate(F.col("word"), F.col("n"))
    leads = short & (F.col("skipped") != F.expr("right(key, 1)"))
    seen = rows.select(
        "word", "n", "skipped", short.alias("short"), leads.alias("leads"),
        F.count(F.lit(1)).over(group).alias("all"),
        F.sum(short.cast("int")).over(group).alias("shorts"),
        F.sum(leads.cast("int")).over(group).alias("led"),
        F.min(F.when(~short, this)).over(group).alias("whole"),
        F.min(F.when(leads, this)).over(group).alias("best_led"),
        F.row_number().over(order).alias("place"),
        F.first(this).over(order).alias("first"),
        F.lead(this).over(order).alias("next")).where("all > 1")
    whole = F.when(F.col("leads"), F.col("whole"))
    other = F.when(F.col("shorts") > 1, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("first")))
    return seen.select(
        "word",
        F.when(F.col("short"), F.col("shorts") - 1 + whole.isNotNull().cast("int")).otherwise(F.col("led")).alias("found"),
        F.when(F.col("short"), F.least(other, whole)).otherwise(F.col("best_led")).alias("best")).where("found > 0")


def gap_hashes(word: str) -> list[tuple[str, str]]:
    """(key, skipped) of a word with each of its letters replaced by a gap, and with a gap put
    before each letter and at the end; texts with a gap that are equal have equal keys."""
    codes, n = [ord(c) + 2 for c in word], len(word)
    heads, tails, powers = [0], [0] * (n + 1), [1]
    for c in codes:
        heads.append((heads[-1] * BASE + c) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    for i in range(n - 1, -1, -1):
        tails[i] = (codes[i] * powers[n - 1 - i] + tails[i + 1]) % PRIME
    rows = []
    for i in range(n + 1):
        head = heads[i] * BASE + GAP
        rows.append((f"{n + 1}:{(head * powers[n - i] + tails[i]) % PRIME:x}", ""))
        if i < n:
            rows.append((f"{n}:{(head * powers[n - 1 - i] + tails[i + 1]) % PRIME:x}", word[i]))
    return rows


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _near_long(words: DataFrame) -> DataFrame:
    """(word, found, best) for the pairs with at least one word over ``LONG`` code points."""
    def hashed(batches):
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, rows = hashlib.sha256(word.encode()).hexdigest(), gap_hashes(word)
                for at in range(0, len(rows), 20_000):
                    some = rows[at:at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some]), pa.array([name] * len(some))], names=["key", "name"])

    def checked(batches):
        for batch in batches:
            keep = pa.array([one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column(0), batch.column(1))], pa.bool_())
            yield batch.filter(keep)

    keys = words.mapInArrow(hashed, "key string, name string").distinct()
    pairs = keys.alias("a").join(keys.alias("b"), "key").where("a.name <> b.name").select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()
    named = words.select(F.sha2(F.col("word").cast("binary"), 256).alias("name"), "word", "n")
    a, b = (named.select(F.col("name").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(f"length(word_a) > {LONG} or length(word_b) > {LONG}")
    near = near.select("word_a", "word_b", "n_b").mapInArrow(checked, "word_a string, word_b string, n_b bigint")
    return near.select(F.col("word_a").alias("word"), F.lit(1).cast("bigint").alias("found"), _candidate(F.col("word_b"), F.col("n_b")).alias("best"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for every word of (word, n) that has a near word, ``best`` being a
    struct of its largest near word (minus_n, word)."""
    rows = rotations(words.where(F.length("word") <= LONG)).repartitionByRange(F.col("key"))
    found = _scan(rows)  # sorts each range by key
    # a word of LONG code points may have a longer neighbour
    found = found.unionByName(_near_long(words.where(F.length("word") >= LONG)))
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): chains are followed by doubling.  A form occurs several
    times as often as its word, so chains are short and end."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group_variants(spark: SparkSession, docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, edit_every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``word_counts``.

    ``form`` is the near word with the largest n (ties: the first in code-point order) if that
    n is at least ``times`` the word's, else null; ``root`` is the last of the forms, the word
    itself if it has none; words without near words have n_near 0.  Null, empty and very long
    texts, repeated rows (each counts) and empty tables are taken; only doc_id and text are
    read."""
    words = written(word_counts(docs, least_length, least_count, edit_every), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    best_n = -F.col("best.minus_n")
    fits = best_n >= times * F.col("n")
    known = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                F.when(fits, F.col("best.word")).alias("form"), F.when(fits, best_n).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
