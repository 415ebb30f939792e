"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Strings that the base rules find are seeds.  Every identifier-like string, seed or not, is an
instance; the one to three words to its left are its patterns.  Spark scores the graph of
patterns and instances in rounds: a pattern is as good as the share of its slots that known
instances fill (slots filled by ordinary words count against it), an instance as good as its
patterns together make it.  Instances that end above ``accept`` are added, with the kind that
their shape allows and their patterns announce most often.

Copies add nothing to a score, since instances are counted once for a pattern.  A pattern
needs ``support`` of all identifier-like occurrences; each of those has at most three
patterns, so at most 3 / support patterns remain and are broadcast to count their slots."""

from __future__ import annotations

import re
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank, written

# Kinds in their order, patterns and limits of the base rules.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LOCAL = r"[A-Za-z0-9._%+-]"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS, IP_PARTS, IP_MOST = (12, 19), (9, 15), 4, 255

_domain, _local = re.compile(DOMAIN).match, re.compile(LOCAL).match
_card, _phone, _dotted = re.compile(CARD).finditer, re.compile(PHONE).finditer, re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
_at, _number = re.compile(r"[\[({][ ]?(?:at|AT)[ ]?[\])}]").finditer, re.compile(r"\(?[0-9](?:[ ().\-/]{0,3}[0-9])+").finditer
_spelled = re.compile(r"[ ]?[A-Za-z0-9-]+(?:[ ]?(?:\.|[\[({][ ]?(?:dot|DOT)[ ]?[\])}])[ ]?[A-Za-z0-9-]+)+").match
_hex = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])").finditer
_digits = re.compile("[^0-9]+").sub

WORDS, NEAR = 3, 200  # words of context at most, and the characters they are looked for in
FOUND = ("row bigint, doc_id bigint, base array<struct<start:int,kind:int,stop:int>>, "
         "candidates array<struct<start:int,stop:int,kind:int,allowed:array<int>,instance:string,patterns:array<string>>>")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each ``@`` takes the local characters before it, down to the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _local(text, start - 1):
            start -= 1
        found = _domain(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Dotted numbers four parts at a time; those with a part over 255 are dropped."""
    out = []
    for run in _dotted(text):
        if run[0].count(".") < IP_PARTS - 1:
            continue
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - IP_PARTS + 1, IP_PARTS):
            four = parts[i:i + IP_PARTS]
            stop = at + sum(map(len, four)) + IP_PARTS - 1
            if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= IP_MOST for x in four):
                out.append((at, stop))
            at = stop + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the base rules in code points, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] + [(a, 1, b) for a, b in ips(text)]
    for kind, matches, (least, most) in ((2, _card(text), CARD_DIGITS), (3, _phone(text), PHONE_DIGITS)):
        for m in matches:
            if least <= len(m[0]) and least <= len(digits := _digits("", m[0])) <= most and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def unlike_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, stop, kinds that the shape allows) of identifier-like strings outside the base
    spans: spelled-out addresses, numbers of 7 to 19 digits, groups of hexadecimal digits."""
    out = []
    for m in _at(text):
        start = m.start() - (text[m.start() - 1:m.start()] == " ")
        stop = start
        while start > 0 and stop - start < 64 and _local(text, start - 1):
            start -= 1
        domain = _spelled(text, m.end())
        if start < stop and domain:
            out.append((start, domain.end(), [0]))
    for m in _number(text):
        n = len(_digits("", m[0])) if m.end() - m.start() >= 7 else 0
        kinds = [2] * (CARD_DIGITS[0] <= n <= CARD_DIGITS[1]) + [3] * (7 <= n <= PHONE_DIGITS[1])
        if kinds:
            out.append((m.start(), m.end(), kinds))
    if text.count(":") >= 3:
        out += [(m.start(), m.end(), [1]) for m in _hex(text)]
    free, at, last = [], 0, 0
    for start, stop, kinds in sorted(out):
        while at < len(base) and base[at][2] <= start:
            at += 1
        # base spans of several kinds may overlap, so look at all that begin before the end
        clear = all(b[2] <= start or b[0] >= stop for b in base[max(0, at - 8):at + 8] if b[0] < stop)
        if clear and start >= last:
            free.append((start, stop, kinds))
            last = stop
    return free


def patterns_before(text: str, start: int) -> list[str]:
    """The last one, two and three words before a place, as long as they are without digits."""
    words = text[max(0, start - NEAR):start].lower().split()[-WORDS:]
    out = []
    for n in range(1, len(words) + 1):
        word = words[-n]
        if len(word) > NEAR // 4 or any(c.isdigit() or c == "@" for c in word):
            break
        if any(c.isalpha() for c in "".join(words[-n:])):
            out.append(" ".join(words[-n:]))
    return out


def _extract(batches):
    first, k = TaskContext.get().partitionId() << 36, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, rows = batch.slice(at, 512), []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                text = text.as_py()
                base = base_spans(text)
                seen = [(a, b, kind, [kind]) for a, kind, b in base] + [(a, b, -1, kinds) for a, b, kinds in unlike_spans(text, base)]
                rows.append((first + k, doc_id, [{"start": a, "kind": kind, "stop": b} for a, kind, b in base],
                             [{"start": a, "stop": b, "kind": kind, "allowed": allowed, "instance": _digits("", text[a:b]) or text[a:b].lower(),
                               "patterns": patterns_before(text, a)} for a, b, kind, allowed in seen]))
                k += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND)], names=["row", "doc_id", "base", "candidates"])


_INT = pa.int32()
_FOUND = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", _INT), ("kind", _INT), ("stop", _INT)])),
          pa.list_(pa.struct([("start", _INT), ("stop", _INT), ("kind", _INT), ("allowed", pa.list_(_INT)),
                              ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))]


def pattern_slots(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, slots): how often each of the patterns stands before a further word."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        known = {p: i for i, p in enumerate(shared.value)}
        lasts, longest = {p.rpartition(" ")[2] for p in known}, max(p.count(" ") for p in known) + 1
        counts = [0] * len(known)
        for batch in batches:
            for text in batch.column(0):
                words = text.as_py().lower().split()
                for j in [j for j, w in enumerate(words) if w in lasts]:
                    if j + 1 == len(words):
                        continue
                    for n in range(1, min(longest, j + 1) + 1):
                        i = known.get(" ".join(words[j - n + 1:j + 1]))
                        if i is not None:
                            counts[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array(counts, pa.int64())], names=["pattern", "slots"])

    found = docs.select(blank("text").alias("text")).mapInArrow(run, "pattern string, slots bigint")
    return found.groupBy("pattern").agg(F.sum("slots").alias("slots"))


def score_graph(edges: DataFrame, patterns: DataFrame, accept: float, follow: float, least: int, rounds: int) -> DataFrame:
    """(instance, score) of instances that are no seeds, from ``edges`` (pattern, instance,
    seed boolean) and ``patterns`` (pattern, size: instances and ordinary words in its slots).

    A pattern scores the sum of its instances' scores (1 for a seed) divided by its size, and
    is followed if that is ``follow`` or more and at least ``least`` of its instances are
    known; an instance scores 1 minus the product of what its patterns lack.  Rounds go on
    until no score moves by 0.001, or to ``rounds``."""
    spark = edges.sparkSession
    scores = spark.createDataFrame([], "instance string, score double")
    for _ in range(rounds):
        known = edges.join(scores, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        good = known.groupBy("pattern").agg(F.sum("score").alias("sum"), F.sum((F.col("score") >= accept).cast("int")).alias("sure"))
        good = good.join(patterns, "pattern").select("pattern", "sure", (F.col("sum") / F.col("size")).alias("worth")).where((F.col("worth") >= follow) & (F.col("sure") >= least))
        lacking = F.log(F.greatest(F.lit(1e-6), 1 - F.col("worth")))
        after = edges.where("not seed").join(good, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(lacking))).alias("score"))
        after = written(after, "pii-scores")
        moved = after.join(scores.withColumnRenamed("score", "old"), "instance", "left").where(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) >= 0.001)
        done = moved.isEmpty()
        scores = after
        if done:
            break
    return scores


def _added(docs: DataFrame, found: DataFrame, accept: float, follow: float, support: float, least: int, rounds: int) -> DataFrame | None:
    """(row, start, kind, stop) of accepted strings that the base rules do not find."""
    seen = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    links = seen.select("instance", (F.col("kind") >= 0).alias("seed"), "kind", F.explode("patterns").alias("pattern"))
    # counted in the task first: a hot pattern or a string of many copies is one row a task
    links = written(links.groupBy("pattern", "instance", "kind", "seed").agg(F.count(F.lit(1)).alias("times")), "pii-links")
    total = seen.count()
    enough = max(least, ceil(support * total))
    each = links.groupBy("pattern", "instance").agg(F.sum("times").alias("times"), F.max("seed").alias("seed"))
    frequent = each.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum("times").alias("times"),
                                           F.sum((~F.col("seed")).cast("int")).alias("open")).where(F.col("instances") >= enough)
    frequent = written(frequent, "pii-patterns")
    if frequent.where("open > 0").isEmpty():
        return None
    names = [r[0] for r in frequent.select("pattern").collect()]  # at most WORDS / support
    slots = pattern_slots(docs, names)
    sized = frequent.join(slots, "pattern", "left").select(
        "pattern", (F.col("instances") + F.greatest(F.lit(0), F.coalesce("slots", F.lit(0)) - F.col("times"))).alias("size"))
    sized = written(sized, "pii-sizes")
    edges = written(each.join(sized, "pattern", "left_semi").select("pattern", "instance", "seed"), "pii-edges")
    scores = score_graph(edges, sized, accept, follow, least, rounds).where(F.col("score") >= accept)
    # the kinds of the seeds in an instance's patterns
    heard = links.where("seed").join(sized, "pattern", "left_semi").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least)
    kinds = edges.where("not seed").join(scores, "instance").join(heard, "pattern").groupBy("instance", "kind").agg(F.sum("seeds").alias("votes"))
    best = Window.partitionBy("row", "start", "stop").orderBy(F.desc("votes"), "kind")
    open_spans = seen.where("kind < 0").select("row", "start", "stop", "instance", F.explode("allowed").alias("kind"))
    chosen = open_spans.join(kinds, ["instance", "kind"]).withColumn("place", F.row_number().over(best)).where("place = 1")
    return chosen.select("row", "start", "kind", "stop")


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def find_personal_data(spark: SparkSession, docs: DataFrame, accept: float = 0.8, follow: float = 0.5, support: float = 1e-4,
                       least: int = 3, rounds: int = 10) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (array of start, kind, stop),
    added (the same, found by context), of every row; kinds are numbered as in ``KINDS``, places
    are code points, stop is exclusive.

    A null or empty text has none.  Repeated rows each get their own; a string that repeats
    counts once for a pattern.  Only doc_id and text are read; an empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text"))
    found = written(texts.mapInArrow(_extract, FOUND), "pii-found")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    span = F.struct("start", "kind", "stop")
    more = _added(docs, found, accept, follow, support, least, rounds)
    if more is None:
        rows = found.withColumn("added", F.filter("base", lambda s: F.lit(False)))
    else:
        more = more.groupBy("row").agg(F.collect_list(span).alias("added"))  # of one text
        rows = found.select("row", "doc_id", "base").join(more, "row", "left")
        rows = rows.withColumn("added", F.coalesce("added", F.filter("base", lambda s: F.lit(False))))
    return rows.select("doc_id", *counts, "base", "added")


def joined(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def personal_data_digest(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, the counts of the base rules, base_sha256 and spans (base and added), as text."""
    rows = find_personal_data(spark, docs, **options)
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       joined(F.concat("base", "added")).alias("spans"))
