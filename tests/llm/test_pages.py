"""Page operators, the queries and the pipeline."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tabsynth.llm import catalog, url_filter, warc
from tests.conftest import SF
from tests.test_oracle import TABLES, _canon

from .test_documents import brute_components, brute_exact, brute_pieces


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [(1, "http://a.net", "same"), (2, "HTTPS://WWW.A.NET/en/x.html?b=1&a=2#f", "same"), (3, None, None), (4, "no scheme", ""), (5, "ftp://x@B.org:80/fr/", "same"),
            (6, "http://org/fr/1\r\nEvil: 1", "é" * 5000), (6, "http://org/fr/1\r\nEvil: 1", "é" * 5000), (None, "http://c.com/", "same"), (None, "http://example.com/de/?", "lone"),
            (9, "http://example.net/en/a://b", "zz"), (0, "http://badexample.net/en/", "é" * 5000), (11, "://", "q"), (12, "http://example.net?x", "q2")]
    return spark.createDataFrame([(*r, "?", 1) for r in rows], "page_id bigint, url string, html string, bundle string, sha int")


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, odd_pages, least):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in odd_pages.collect()]
    first = {}
    for i, p in rows:
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, p in rows:
        to = first.get(p)
        to = None if to is None or to == i else to
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    got = warc.archive_round_trip(spark, odd_pages, least)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert warc.archive_round_trip(spark, odd_pages.limit(0)).count() == 0


def test_bundles_are_seekable(spark, tmp_path, odd_pages):
    import zstandard

    index = warc.write_archives(odd_pages, f"file:{tmp_path}/w", frame_bytes=300, bundle_bytes=600)
    rows = index.collect()
    assert len({r["bundle"] for r in rows}) > 1 and len(rows) == 13
    for uri in {r["bundle"] for r in rows}:
        with open(uri.replace("file:", ""), "rb") as f:
            raw = f.read()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        parts = [warc.read_frame(uri, s, p) for s, p, _ in warc.seek_table(uri)]
        assert b"".join(parts) == whole and [len(p) for p in parts] == [n for _, _, n in warc.seek_table(uri)]
        for r in (r for r in rows if r["bundle"] == uri):
            head, _, _ = warc.read_record(parts[r["frame"]], r["offset"])
            assert warc.record_id(head["WARC-Record-ID"]) == r["page_id"] and "Evil" not in head
    found = warc.fetch_records(spark, index, spark.createDataFrame([(6,), (0,)], "page_id bigint")).collect()
    assert Counter((r["page_id"], r["payload"]) for r in found) == {(6, None): 2, (0, "é" * 5000): 1}


def test_listed_rules(spark, odd_pages):
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in
           url_filter.judge_urls(spark, odd_pages, spark.createDataFrame([], "url string, bad boolean"), catalog.URL_RULES).collect()}
    assert got == {
        (1, "a.net", ""): (None, "allow"), (2, "www.a.net", "/en/x.html"): ("net/", "block"), (3, "", ""): (None, "allow"), (4, "", ""): (None, "allow"),
        (5, "x@b.org:80", "/fr/"): (None, "allow"), (6, "org", "/fr/1\r\nEvil: 1"): ("org/fr/", "allow"), (None, "c.com", "/"): (None, "allow"),
        (None, "example.com", "/de/"): ("example.com/de/", "block"), (9, "example.net", "/en/a://b"): ("example.net/en/", "allow"),
        (0, "badexample.net", "/en/"): ("net/", "block"), (11, "", ""): (None, "allow"), (12, "example.net", ""): (None, "allow")}


def test_mined_rules(spark):
    bad = [(f"http://win.casino.com/play/{i}.php?id=1", True) for i in range(40)] + [(f"http://blog.casino.com/post/{i}.php", i % 4 == 0) for i in range(40)]
    good = [(f"http://site{i}.org/play/{i}", False) for i in range(60)] + [("http://nolabel.org/", None)]
    labelled = spark.createDataFrame(bad + good, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://win.casino.com/"), (2, "http://blog.casino.com/play/"), (3, "http://x.org/play/1"), (4, None)], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark, pages, labelled, [], 0.05, 0.8).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_rules_of_three_tokens_block(spark):
    def rows(host, folder, kind, bad, n=40):
        return [(f"http://{host}.com/{folder}/{i}.{kind}", bad) for i in range(n)]
    # all three tokens together are bad, each pair of them is mostly clean
    labelled = spark.createDataFrame(rows("aa", "play", "php", True) + [r for h, f, k in (("aa", "play", "txt"), ("aa", "post", "php"), ("bb", "play", "php")) for r in rows(h, f, k, False, 60)], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://aa.com/play/x.php"), (2, "http://aa.com/play/x.txt"), (3, "http://aa.com/post/x.php"), (4, "http://bb.com/play/x.php")], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark, pages, labelled, [], 0.05, 0.5).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    learn = [(["a", "b", "c", "d"], i < 9) for i in range(10)] + [(["a", "b"], False)] * 40 + [(["c", "d"], False)] * 40
    mined = url_filter.mine_rules(spark.createDataFrame(learn, "tokens array<string>, bad boolean"), 0.05, 0.5).collect()
    assert sorted(r["terms"] for r in mined) == [["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]]  # larger ones are no surer


def test_url_query_against_rules_of_every_size(spark):
    import re
    from itertools import combinations

    from pyspark.sql import functions as F

    u = F.col("url")
    tokens = url_filter.url_tokens(u, url_filter.host_of(u), url_filter.path_of(u))
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", tokens.alias("tokens")).collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    n, bad, total = Counter(), Counter(), 0
    for r in pages.values():
        number = re.match(r"[^?#]*?://[^/?#]*[^?#]*?/([0-9]{1,18})", r["url"] or "")
        label = labels.get(int(number[1])) if number else None
        if label is None or not r["tokens"] or (label["quality"] is None or label["toxic"] is None):
            continue
        total += 1
        for k in range(1, 9):
            for part in combinations(sorted(r["tokens"]), k):
                n[part] += 1
                bad[part] += label["quality"] == 0 or label["toxic"] == 1
    rules = [set(x) for x in bad if bad[x] >= math.ceil(0.005 * total) and bad[x] >= 0.5 * n[x]]
    assert any(len(x) > 2 for x in rules)
    listed = dict((r, v) for v, r in catalog.URL_RULES)
    got = catalog.op8_url_filter(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        mined = "block" if any(x <= set(pages[r["page_id"]]["tokens"]) for x in rules) else "allow"
        assert r["verdict"] == listed.get(r["rule"], mined)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall())


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


def brute_pipeline(rows):
    import regex

    rows = [(i, t) for i, t in rows if t and regex.search(r"\p{L}", t)]
    kept = {i: k for i, k, _, _ in brute_exact(rows)}
    rows = [(i, t) for i, t in rows if kept[i] == i]
    parts = {i: c for i, _, c in brute_components(rows)}
    return brute_pieces([(i, t) for i, t in rows if parts[i] == i])


def test_pipeline(spark, texts):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == brute_pipeline(texts)
    by = defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert len(by) <= math.ceil(sum(by.values()) / 2048) * 1.02 + 1


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= df.count()
