"""Document operators against brute force, on sf0.001 and on odd rows."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash

from tabsynth.llm import bpe, exact_dedup, language_id, licenses, lm, packing, simhash, syncmers

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(i):
    return (i is None, i or 0)


# exact dedup

def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_duplicates(request, name, partitions):
    df = request.getfixturevalue(name)
    got = exact_dedup.exact_duplicates(df, partitions=partitions).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(pairs(df))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) <= {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_hot_text_spans_partitions(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 > 0 then 'same  text' else concat('t', id) end as text")
    got = exact_dedup.exact_duplicates(df, partitions=16)
    assert {(r["keep_id"], r["n"]) for r in got.where("group_size > 1").groupBy("keep_id", "group_size").count().withColumnRenamed("group_size", "n").collect()} == {(1, 2000)}
    assert got.where("kept").count() == 1001


def test_drop_exact_keeps_columns(odd):
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert Counter(r["doc_id"] for r in left.collect()) == {-3: 1, 2: 1, 5: 1, 7: 1, 8: 1, 9: 1, None: 1, 12: 1, 13: 1, 14: 1}


# SimHash

def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min([x for x in (least.get(root(k)), i) if x is not None], default=None)
    return sorted(((i, f"{fps[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_near_duplicates(request, name):
    df = request.getfixturevalue(name)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == brute_components(pairs(df))


def test_pairs_and_shards_find_every_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype="uint64")
    flips = np.uint64(1) << rng.integers(0, 64, (300, 3)).astype("uint64")
    points = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1], base ^ flips[:, 2]]))
    want = {(int(a), int(b)) for a in points for b in points[simhash.distance(points, a) <= 2] if a < b}
    tree = simhash.upper_tree(points[::7], 4)
    got = set()
    shards = simhash.deal(tree, points, 2)
    assert sum(home.sum() for _, _, home in shards) == len(points)
    for _, at, home in shards:
        homes, everyone = points[at[home]], points[at]
        for a, b in simhash.pairs_within(homes, everyone, 2):
            got |= {(min(x, y), max(x, y)) for x, y in zip(homes[a].tolist(), everyone[b].tolist()) if x != y}
    assert got == want and len(want) > 300


def test_long_chain_is_one_component(spark):
    from tabsynth.llm.components import connected_components

    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(500, 510).selectExpr("id as a", "500 as b"))
    got = {r["a"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 510)}}


def test_drop_near_keeps_one_of_each(odd):
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    want = {c for _, _, c in brute_components(pairs(odd))}
    assert Counter(r["doc_id"] for r in left.collect()) == {i: 1 for i in want}


def test_drop_near_keeps_unrelated_texts_that_share_an_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = spark.createDataFrame([(None, a), (None, b), (None, b), (4, c), (4, d), (5, d)], "doc_id bigint, text string")
    left = simhash.drop_near_duplicates(rows).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(None, a), (None, b), (4, c), (4, d)], key=repr)


# packing

def brute_pieces(rows, limit=2048):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(JSON), []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= limit else len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        out += [(i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_packing(spark, request, name):
    df = request.getfixturevalue(name)
    got = packing.pack_documents(spark, df, JSON).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == brute_pieces(pairs(df))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    if got:
        assert len(by) <= math.ceil(sum(r["length"] for r in got) / 2048) * 1.02 + 1


def test_best_fit_takes_tightest_and_closes_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 2, 4)] == [(0, 0), (1, 0), (2, 0), (2, 8), (0, 6)]


def test_chunks_encode_like_whole_texts():
    import random

    from tokenizers import Tokenizer

    with open(JSON, encoding="utf-8") as f:
        encoder = packing.ChunkEncoder(f.read())
    whole, draw = Tokenizer.from_file(JSON), random.Random(3)
    alphabet = [*" \n\t\x0b\x1c\x85\u00a0\u3000\u200b'sS1²½Ⅷ٣é漢B.,!_-́\r", "  ", "'re", "<|endoftext|>", "😀"]
    some = ["".join(draw.choices(alphabet, k=draw.randint(0, 14))) for _ in range(3000)]
    assert [array("I", b).tolist() for b in map(bytes, encoder.encode(some))] == [whole.encode(s, add_special_tokens=False).ids for s in some]


# BPE

def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_bpe_round_trip(spark, request, name):
    df = request.getfixturevalue(name)
    _, t = tiktoken_encoding()
    want = []
    for i, text in pairs(df):
        ids = t.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.code_digests(spark, df, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_bpe_texts_out_and_in(spark, odd):
    coded = bpe.encode_texts(spark, odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_ids(spark, coded, RANKS, portion=3)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in pairs(odd)), key=repr)


def test_transducer_equals_library_on_random_bytes():
    import random

    ranks, t = tiktoken_encoding()
    machine, draw = bpe.BpeTransducer(ranks), random.Random(7)
    letters = "abcdeéñüßtionthe 漢字аб😀'"
    for _ in range(3000):
        piece = "".join(draw.choices(letters, k=draw.randint(1, 30)))
        assert machine.encode_piece(piece.encode()) == t._core_bpe.encode_single_piece(piece.encode()), piece
    tokens = [x for x in ranks if len(x) > 2]
    for _ in range(3000):
        piece = b"".join(draw.choices(tokens, k=3))
        assert machine.encode_piece(piece) == t._core_bpe.encode_single_piece(piece)


def test_pair_test_equals_merging():
    import random

    ranks, _ = tiktoken_encoding()
    machine, draw = bpe.BpeTransducer(ranks), random.Random(11)
    alone = [i for i in draw.sample(sorted(ranks.values()), 3000) if machine.merged(machine.bytes_of[i]) == [i]]
    for _ in range(5000):
        a, b = draw.choices(alone, k=2)
        assert machine._apart(a, b) == (machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])
    for _ in range(2000):  # both halves of one token: many pairs that merge
        whole = machine.bytes_of[draw.choice(alone)]
        cut = draw.randrange(1, len(whole)) if len(whole) > 1 else 0
        a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
        if a is not None and b is not None:
            assert machine._apart(a, b) == (machine.merged(whole) == [a, b])


def test_pair_test_where_ranks_come_out_of_order():
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"bc": 9, b"abc": 5, b"cab": 7, b"ca": 8}
    machine = bpe.BpeTransducer(ranks)
    assert machine._edges(5) is None  # bc (9) comes before abc (5)
    for a in ranks.values():
        for b in ranks.values():
            if machine.merged(machine.bytes_of[a]) == [a] and machine.merged(machine.bytes_of[b]) == [b]:
                assert machine._apart(a, b) == (machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


def test_memo_keeps_what_is_asked_for_again():
    made = []
    memo = packing.Recent(lambda c: made.append(c) or c.upper(), size=3)
    for c in "abcadaeafagahaiaja":
        assert memo[c] == c.upper()
        assert len(memo) <= 3 and len(memo.old) <= 3
    assert made.count("a") == 1 and [memo[c] for c in "bcd"] == ["B", "C", "D"]


def test_chunk_encoder_with_a_small_memo(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = packing.ChunkEncoder(f.read())
    encoder.memo.size = 5
    plain = Tokenizer.from_file(path)
    texts = ["", "one two three, four five six", "one two <|endoftext|> two", "six five four three two one\n\n漢字 ÉCOLE", " "] * 3
    for _ in range(2):
        assert [memoryview(b).cast("I").tolist() for b in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_stream_decoder_waits_and_replaces():
    data = "aé漢😀".encode()
    stream = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    assert "".join([*(stream.feed([b]) for b in data), stream.close()]) == "aé漢😀"
    stream = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    bad = b"a\xff\xe6\xbc b\xf0\x9f"
    assert "".join([*(stream.feed([b]) for b in bad), stream.close()]) == bad.decode("utf-8", "replace")


# language ID

def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5


def test_language_held_out(spark, docs):
    got = language_id.predict_languages(spark, docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count() and all(r["held_out"] == (held(r["doc_id"]) == 0) for r in got)
    judged = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, odd, none):
    got = language_id.predict_languages(spark, odd)
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert len(rows) == odd.count()
    assert {i for i, p, _ in rows if p == "und"} == {2, 3, 7, 8}
    assert all(s == 0 for _, p, s in rows if p == "und")
    assert language_id.predict_languages(spark, none).count() == 0
    left = language_id.keep_identified(spark, odd)
    assert left.columns == odd.columns and not {2, 3, 7, 8} & {r["doc_id"] for r in left.collect()}


def test_language_stage_keeps_unsure_documents(spark):
    rows = [(k, f"{w} {w}", w[:1]) for k, w in enumerate(["aaa", "bbb", "ccc", "ddd"] * 20)] + [(100, "漢字", None), (101, "12", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    scores = {r["doc_id"]: r["score"] for r in language_id.predict_languages(spark, df).collect()}
    assert scores[100] < 0.5
    assert {r["doc_id"] for r in language_id.keep_identified(spark, df).collect()} == {*range(80), 100}


def test_language_backs_off():
    import numpy as np

    model = {"languages": ["a", "b"], "longest": 2, "words": (["yes"], np.array([[-1.0, -7.0]])),
             "grams": (["qu", "q", "z"], np.array([[-7.0, -1.0], [-1.0, -7.0], [-2.0, -2.0]]))}
    scorer = language_id.Scorer(model)
    assert scorer.predict("yes")[0] == "a" and scorer.predict("que")[0] == "b" and scorer.predict("q")[0] == "a"
    assert scorer.predict("zz") == ("a", 0.5) and scorer.predict("ooo") == ("a", 0.5) and scorer.predict(None) == ("und", 0.0)


# syncmers

def brute_edit(rows):
    order = sorted({i for i, _ in rows}, key=lambda i: (i is None, -(i or 0)))
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    out = []
    for i, t in rows:
        t = t or ""
        nxt = [x or "" for j, x in rows if j == after[i]]
        n = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[:len(t) - n] + min(nxt, key=lambda x: x.encode())[:n]).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_fingerprints(request, name):
    df = request.getfixturevalue(name)
    got = syncmers.fingerprint_documents(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == brute_edit(pairs(df))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    if name == "docs":
        long = [r for r in got if r["n_chars"] > 400]
        assert sum(r["near_edited"] > 0.3 for r in long) > 0.9 * len(long)
        assert sum(r["near_next"] < 0.2 for r in long) > 0.8 * len(long)


def test_syncmers_by_brute_force(spark):
    text = " ".join(f"w{i % 37}" for i in range(300))
    rows = spark.createDataFrame([(1, text), (2, "x y z " + text), (3, "a b"), (4, "")], "doc_id bigint, text string")
    got = defaultdict(dict)
    for r in syncmers.match_positions(rows).collect():
        got[r["doc_id"]][r["position"]] = r["hash"]
    word = {r["w"]: r["h"] for r in spark.createDataFrame([(f"w{i}",) for i in range(37)], "w string").selectExpr("w", "xxhash64(w) as h").collect()}
    h = [word[f"w{i % 37}"] for i in range(300)]
    two = {r["a"]: r["h"] for r in spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(299)], "a int, x bigint, y bigint").selectExpr("a", "xxhash64(x, y) as h").collect()}
    want = [i for i in range(296) if min(two[i + j] for j in range(4)) in (two[i], two[i + 3])]
    assert sorted(got[1]) == want
    assert {p + 3: v for p, v in got[1].items()}.items() <= got[2].items()  # the same anchors, moved
    assert len(got[3]) == 1 and not got[4]


def test_equal_texts_equal_fingerprints(spark):
    rows = spark.createDataFrame([(1, "some words in a row here"), (2, "some words in a row here")], "doc_id bigint, text string")
    a, b = syncmers.fingerprint_documents(rows).collect()
    assert a["fingerprint"] == b["fingerprint"] and a["near_next"] == 1.0


# licences

def test_license_scan(spark, docs, odd, none):
    import pyspark.sql.functions as F

    listed = dict((t, f) for f, t in licenses.TEMPLATES)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).collect()
    want = {(r["doc_id"], r["at"]): listed[r["line"]] for r in lines if r["line"] in listed}
    plates = spark.createDataFrame([(10**9, "Her driving license plate was red\nlicense", "en", None, 40)], docs.schema)
    got = licenses.scan_licenses(spark, docs.union(plates)).collect()
    assert {(r["doc_id"], r["paragraph"]): r["family"] for r in got if r["confirmed"]} == want and want
    assert all(r["family"] == "unknown" for r in got if r["doc_id"] == 10**9)
    assert licenses.scan_licenses(spark, odd).count() == 0 and licenses.scan_licenses(spark, none).count() == 0


def test_license_lines_without_cue_and_wrapped_notices(spark, docs):
    mit, gpl = licenses.TEMPLATES[1][1].split(), licenses.TEMPLATES[5][1].split()
    wrapped = "\n".join(" ".join(mit[i:i + 7]) for i in range(0, len(mit), 7))
    header = "\n".join("# " + " ".join(gpl[i:i + 9]) for i in range(0, len(gpl), 9))
    bsd = next(t for f, t in licenses.TEMPLATES if f == "BSD-3-Clause").split(" ", 1)[1]
    texts = {1: "x y z\n\nunder CC BY-NC 4.0", 2: "Released under the MIT", 3: bsd, 4: f"some words first\n\n{wrapped}\n\nand after", 5: header,
             6: "She had the permission of the owner.\nHis licence was taken away"}
    extra = spark.createDataFrame([(10**9 + i, t, "en", None, len(t)) for i, t in texts.items()], docs.schema)
    rows = licenses.scan_licenses(spark, docs.union(extra)).where(f"doc_id > {10**9}").collect()
    got = {(r["doc_id"] - 10**9, r["paragraph"], r["n_lines"]): r["family"] for r in rows if r["confirmed"]}
    assert got == {(1, 2, 1): "CC-BY-NC-4.0", (2, 0, 1): "MIT", (3, 0, 1): "BSD-3-Clause", (4, 2, wrapped.count("\n") + 1): "MIT", (5, 0, header.count("\n") + 1): "GPL-3.0"}


def _span_by_hand(pairs, parts):
    """(coverage, start, end) of the best, then leftmost, then shortest stretch."""
    places = [(i, p) for i, p in enumerate(pairs) if p in parts]
    found = []
    for i, _ in places:
        held = [(j, p) for j, p in places if i <= j < i + 2 * len(parts)]
        found.append((len({p for _, p in held}) / len(parts), -i, held[-1][0] + 1))
    best = max(found)
    return best[0], -best[1], best[2]


def test_license_spans_by_brute_force(spark):
    import random

    import pyspark.sql.functions as F

    parts, draw = licenses.template_pairs(spark), random.Random(3)
    rows = []
    for i in range(40):
        t = draw.randrange(len(parts))
        words = " ".join(p.split()[0] for p in parts[t]).split() + [parts[t][-1].split()[-1]]
        foreign = [draw.choice(["red", "house", "license", "the", "under", "version"]) for _ in range(draw.randrange(300))]
        cut = draw.randrange(len(foreign) + 1)
        text = foreign[:cut] + [w for w in words if draw.random() > 0.1] + foreign[cut:] + (words if i % 3 == 0 else [])
        rows.append((i, t, text))
    df = spark.createDataFrame(rows, "i int, t int, words array<string>").withColumn("pairs", licenses.pairs_of("words"))
    got = df.withColumn("span", licenses.spans(F.col("pairs"), F.array("t"), parts)[0]).collect()
    for r in got:
        want = _span_by_hand(r["pairs"], parts[r["t"]])
        assert (r["span"]["coverage"], r["span"]["start"], r["span"]["end"]) == want
    far = spark.createDataFrame([(["a b", "b c"],)], "pairs array<string>").select(licenses.spans(F.col("pairs"), F.array().cast("array<int>"), parts).alias("s"))
    assert far.first()["s"] == []


def test_licenses_amid_prose_and_siblings(spark, docs):
    prose = " ".join(r["text"].replace("\n", " ") for r in docs.where("lang = 'en' and n_chars < 3000").orderBy("doc_id").limit(4).collect())[:4000]
    texts, want = {}, {}
    for i, (family, notice) in enumerate(licenses.TEMPLATES):
        words = notice.split()
        wrapped = "\n".join(" ".join(words[k:k + 8]) for k in range(0, len(words), 8))
        texts[3 * i] = f"{prose} {notice} {prose}"
        texts[3 * i + 1] = f"{prose}\n{wrapped}\n{prose}"
        texts[3 * i + 2] = f"# {notice}"
        want.update({3 * i + k: {family} for k in range(3)})
    two = f"{prose} {licenses.TEMPLATES[1][1]} {prose} {licenses.TEMPLATES[5][1]} {prose}"
    texts[10**6], want[10**6] = two, {"MIT", "GPL-3.0"}
    texts[10**6 + 1] = f"{'word of the ' * 100_000}{licenses.TEMPLATES[1][1]}"
    want[10**6 + 1] = {"MIT"}
    extra = spark.createDataFrame([(10**9 + i, t, "en", None, len(t)) for i, t in texts.items()], docs.schema)
    rows = licenses.scan_licenses(spark, docs.union(extra)).where(f"doc_id >= {10**9}").collect()
    got = {}
    for r in rows:
        if r["confirmed"]:
            got.setdefault(r["doc_id"] - 10**9, []).append(r["family"])
    assert {k: set(v) for k, v in got.items()} == want
    assert all(len(got[k]) == len(want[k]) for k in want)


# language model

@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_lm(spark, request, name):
    df = request.getfixturevalue(name)
    rows = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in pairs(df)]
    train = [w for i, w in rows if held(i) != 1]
    c, b = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([b"\n", *w], w))
    n, v, m = sum(c.values()), len(c), 50.0
    want = []
    for i, w in rows:
        p1 = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        p2 = [(b[p] + m * q) / (c[p[0]] + m) for p, q in zip(zip([b"\n", *w], w), p1)]
        want.append((str(i), held(i) == 1, len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, p1)), sum(map(math.log10, p2))))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score_documents(spark, df).collect()]
    assert len(got) == len(want)
    for a, e in zip(sorted(got), sorted(want)):
        assert a[:5] == e[:5] and a[5] == pytest.approx(e[5], rel=1e-9)
        assert a[6] == pytest.approx(e[6], abs=6e-4 * a[2] + 1e-9)  # half a quantisation step a token
    if name == "docs":
        assert sum(a[6] for a in got if a[1]) > sum(a[5] for a in got if a[1])


def test_lm_third_order_uses_longer_contexts(spark, docs):
    two = {r["doc_id"]: r["score"] for r in lm.score_documents(spark, docs).collect()}
    three = {r["doc_id"]: (r["held_out"], r["score"]) for r in lm.score_documents(spark, docs, order=3).collect()}
    assert sum(s for h, s in three.values() if not h) > sum(two[i] for i, (h, _) in three.items() if not h)


def brute_lm3(rows, m=50.0):
    """(id, score) at order 3; no context reaches over the beginning of a text."""
    rows = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c, b, t = Counter(), Counter(), Counter()
    for i, w in rows:
        if held(i) != 1:
            c.update(w)
            b.update(zip([b"\n", *w], w))
            t.update(zip([b"\n", *w], w, w[1:]))
    n, v, out = sum(c.values()), len(c), []
    for i, w in rows:
        score, past = 0.0, [b"\n", *w]
        for k, x in enumerate(w):
            p = (c[x] + 0.5) / (n + 0.5 * (v + 1))
            p = (b[past[k], x] + m * p) / (c[past[k]] + m)
            if k:
                h = (past[k - 1], past[k])
                p = (t[*h, x] + m * p) / (b[h] + m)
            score += math.log10(p)
        out.append((str(i), len(w), score))
    return out


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_lm_query_follows_two_words_of_context(spark, request, tmp_path, name):
    from tabsynth.llm import catalog

    df = request.getfixturevalue(name)
    df.write.parquet(f"file:{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in catalog.op9_lm_scoring(spark, f"file:{tmp_path}").collect())
    want = sorted(brute_lm3(pairs(df)))
    assert len(got) == len(want)
    for a, e in zip(got, want):
        assert a[:2] == e[:2] and a[2] == pytest.approx(e[2], abs=1.2e-3 * a[1] + 1e-9)  # half a quantisation step a level and token


def test_lm_messages_name_a_context_once():
    """Whatever the number of shards, only frequent contexts are in the messages of several."""
    import numpy as np

    rng = np.random.default_rng(5)
    pairs_ = np.unique(np.concatenate([rng.integers(0, 300, (9000, 2)), [[7, 1 << 40], [300, 0]]]), axis=0).astype("uint64")
    context, word = pairs_[:, 0], pairs_[:, 1]
    count = np.where(context < 3, lm.SPREAD, lm.SPREAD - 1)
    for shards in (1, 12, 400):
        order, bounds = lm.routed(lm.shard_keys(context, word, count), shards)
        sent = {}
        for s in range(shards):
            if len(part := order[bounds[s]:bounds[s + 1]]):
                heads, *message = lm.grouped(context[part], word[part])
                c, w = lm.ungrouped(*lm.unpacked(lm.packed(*message)))
                assert (c == context[part]).all() and (w == word[part]).all() and (context[part[heads]] == np.unique(c)).all()
                for x in np.unique(c):
                    sent[int(x)] = sent.get(int(x), 0) + 1
        assert len(sent) == 301 and all(n == 1 for x, n in sent.items() if x >= 3)
        assert shards == 1 or all(sent[x] > 1 for x in range(3))


def test_lm_pairs_in_order_and_ones_of_a_word():
    import numpy as np

    from tabsynth.llm.eliasfano import EliasFano

    rng = np.random.default_rng(6)
    for top in (50, 1 << 40):  # the second does not fit one number
        c, w = rng.integers(0, top, 2000, dtype="uint64"), rng.integers(0, top, 2000, dtype="uint64")
        order, want = lm.in_order(c, w), np.lexsort((w, c))
        assert (c[order] == c[want]).all() and (w[order] == w[want]).all()
    assert len(lm.in_order(c[:0], w[:0])) == 0
    words = np.concatenate([rng.integers(0, 1 << 63, 300, dtype="uint64"), [np.uint64(1 << 63), np.uint64(2**64 - 1)]]).astype("uint64")
    ones = [(x, r, at) for x in words.tolist() for r, at in enumerate(i for i in range(64) if x >> i & 1)]
    x, r, at = (np.array(v, dtype=t) for v, t in zip(zip(*ones), ("uint64", "int64", "int64")))
    assert (EliasFano._select_in_word(x, r) == at).all()


def test_elias_fano_and_trie():
    import numpy as np

    from tabsynth.llm.eliasfano import EliasFano, TrieLevel

    rng = np.random.default_rng(2)
    for top, n in ((1, 1), (10, 50), (1 << 20, 1000), (1 << 60, 3000)):
        values = np.sort(rng.integers(0, top, n, dtype="uint64"))
        coded, _ = EliasFano.load(EliasFano.build(values).dump(), 0)
        assert (coded.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 5, 500, dtype="uint64"), [np.uint64(0)]]).astype("uint64")
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    pairs_ = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    have, miss = pairs_[::2], pairs_[1::2]
    p = rng.random(len(have)) * 0.9 + 0.05
    trie = TrieLevel.load(TrieLevel.build(have[:, 0], have[:, 1], p).dump())
    at = trie.find(have[:, 0], have[:, 1])
    assert (at == np.arange(len(have))).all() and np.allclose(np.log10(trie.probability(at)), np.log10(p), atol=6e-4)
    assert (trie.find(miss[:, 0], miss[:, 1]) == -1).all()
    empty = TrieLevel.load(TrieLevel.build(have[:0, 0], have[:0, 1], p[:0]).dump())
    assert (empty.find(miss[:, 0], miss[:, 1]) == -1).all()
