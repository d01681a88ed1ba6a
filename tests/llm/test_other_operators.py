import hashlib
import tarfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann, langid, media, mixing, sharding, urls
from tidelog.llm.storage import Files

from .conftest import prose, rows


# --- URL reputation


@pytest.fixture(scope="module")
def pages(spark):
    source = [(1, "http://A.Example.net/en/1?x"), (2, "https://www.example.com/de/1"), (3, "http://x.org/fr/"), (4, None), (5, "no scheme"), (6, "http://bad.example.com?q=/de/"), (7, "http://net/"), (8, "ftp://host.net"), (9, "http://"), (None, "http://a.b/#c/d"), (1, "http://A.Example.net/en/1?x")]
    source += [(100 + i, f"http://bad.example.com/{i}") for i in range(40)] + [(200 + i, f"http://good{i % 5}.example.com/{i}") for i in range(60)]
    return spark.createDataFrame(source, "page_id long, url string")


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(60)] + [(1, None), (None, 1), (205, 0)], "page_id long, bad int")


def test_urls(pages, outcomes):
    out = urls.judge(pages, outcomes)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == pages.count()
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.com/de/", "block") and got[3]["verdict"] == "allow" and got[7]["rule"] == "net/"
    assert (got[4]["host"], got[4]["path"], got[5]["host"], got[9]["host"]) == ("", "", "", "") and got[8]["rule"] is None
    assert (got[6]["host"], got[6]["path"], got[6]["rule"]) == ("bad.example.com", "", None) and got[None]["path"] == "/"
    assert got[100]["verdict"] == "block" and got[200]["verdict"] == "allow" and got[100]["bad_mean"] > got[200]["bad_mean"]


def test_shrinkage_grows_weaker_with_evidence(spark):
    counts = [("few.x.com", 1, 1), ("many.x.com", 200, 200), ("none.x.com", 0, 0)] + [(f"h{i}.x.com", 20, 1) for i in range(20)]
    got = {r["host"]: r for r in urls.reputation(spark.createDataFrame(counts, "host string, n long, k long")).collect()}
    assert got["none.x.com"]["mean"] < got["few.x.com"]["mean"] < got["many.x.com"]["mean"] and got["many.x.com"]["bound"] > 0.5


def test_domains(spark):
    hosts = ["a.b.example.com", "example.com:8080", "x.example.co.uk", "co.uk", "example.co.uk.", "1.2.3.4:80", "1.2.3.4", "[::1]:80", "localhost", "", "u:p@a.example.org", "co.com", "a.b.de", "x.com.br"]
    want = [("example.com", "com"), ("example.com", "com"), ("example.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.co.uk", "co.uk"), ("1.2.3.4", "(address)"), ("1.2.3.4", "(address)"), ("[::1]", "(address)"), ("localhost", "localhost"), ("", ""), ("example.org", "org"), ("co.com", "com"), ("b.de", "de"), ("x.com.br", "com.br")]
    domain, suffix = urls.domain_of(F.col("h"))
    got = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").select("i", domain, suffix).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == want


def test_urls_empty(pages, outcomes):
    assert urls.judge(pages.limit(0), outcomes).count() == 0
    assert urls.judge(pages, outcomes.limit(0)).where("rule is null and verdict is null").count() == 0
    assert urls.judge(pages.withColumns({"n": F.lit(1), "host": F.lit("h"), "m": F.lit(2)}), outcomes).count() == pages.count()


# --- media


def test_media_round_trip(spark, docs, crowded):
    want = Counter()
    for d, t, *_ in rows():
        p = media.to_payload(t)
        image = media.to_image(p)
        assert media.from_image(image) == p and len(p) % 576 == 0 and len(p) > 0
        want[(None if d is None else str(d), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(p))] += 1
    for frame in (docs, crowded):
        root = media.write_archives(frame)
        got = media.features(media.read_archives(spark, root, rangeBytes="4096"))
        assert Counter(map(tuple, got.collect())) == want


def test_archives_are_tar_files_of_pngs(spark, docs, empty):
    root = media.write_archives(docs)
    names = [n for n, _ in Files(root).list(".tar")]
    members = 0
    for n in names:
        with Files(root).open(n) as f, tarfile.open(fileobj=f) as tar:
            members += sum(1 for m in tar if tar.extractfile(m).read(8) == b"\x89PNG\r\n\x1a\n")
    assert members == docs.count()
    assert media.features(media.read_archives(spark, media.write_archives(empty))).count() == 0


def test_damaged_member_leaves_its_neighbours(spark, docs):
    root = media.write_archives(docs.coalesce(1))
    name, _ = Files(root).list(".tar")[0]
    path = Files(root)._path(name)
    data = bytearray(open(path, "rb").read())
    data[512 + 60] ^= 0xFF
    open(path, "wb").write(data)
    found = media.read_archives(spark, root, onError="record", retries="1").collect()
    assert sum(r["error"] is not None for r in found) == 1 and len(found) == docs.count()
    with pytest.raises(Exception, match="checksum"):
        media.read_archives(spark, root, retries="0").count()


def archive_of(tmp_path, bodies):
    """A tar of these bodies, and their (offset, size, checksum)."""
    data, entries = b"", []
    for k, body in enumerate(bodies):
        info = tarfile.TarInfo(str(k))
        info.size = len(body)
        entries.append((len(data) + 512, len(body), zlib.crc32(body)))
        data += info.tobuf() + body + bytes(-len(body) % 512)
    (tmp_path / "a.tar").write_bytes(data)
    return entries


def test_members_are_retried_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    bodies = [media.to_image(media.to_payload("x" * (100 * k))) for k in range(9)]
    entries = archive_of(tmp_path, bodies)
    opened, failing = [], {4: 2}  # the fifth member's first two reads fail

    class Flaky:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def read(self, n):
            at = self.f.tell()
            for k, (offset, *_) in enumerate(entries):
                if at == offset - 512 and failing.get(k, 0):
                    failing[k] -= 1
                    raise OSError("lost")
            return self.f.read(n)

    class FlakyFiles(Files):
        def open(self, name):
            opened.append(name)
            return Flaky(super().open(name))

    reader = media.ArchiveReader({"path": str(tmp_path), "retries": "2"})
    got = list(reader._stream(FlakyFiles(str(tmp_path)), "a.tar", entries))
    assert [(o, m, c, e) for o, m, c, e in got] == [(e[0], str(k), b, None) for k, (e, b) in enumerate(zip(entries, bodies))]
    assert len(opened) == 4  # the pass, two tries of the one member, and the pass from the next member on


def test_a_range_is_one_pass(tmp_path):
    bodies = [bytes([k]) * (1 + 300 * k) for k in range(20)]
    entries = archive_of(tmp_path, bodies)
    opened = []

    class Counting(Files):
        def open(self, name):
            opened.append(name)
            return super().open(name)

    got = list(media.ArchiveReader({"path": str(tmp_path)})._stream(Counting(str(tmp_path)), "a.tar", entries[3:]))
    assert [c for _, _, c, _ in got] == bodies[3:] and opened == ["a.tar"]


def test_member_names_carry_any_id(spark):
    ids = [None, "null", "=x", "==", "7", "été"]
    assert [media.member_id(media.member_name(i)) for i in ids] == ids
    df = spark.createDataFrame([(i, "text") for i in ids], "doc_id string, text string")
    assert Counter(r["doc_id"] for r in media.features(media.read_archives(spark, media.write_archives(df))).collect()) == Counter(ids)


def test_folders_by_sparks_names():
    from tidelog.llm.storage import plain_uri

    names = ["s3a://b/x y", "s3://b/x", "dbfs:/mnt/a", "file:///tmp/a", "/tmp/a", "abfss://c@h/x", "wasbs://c@h/x", "hdfs://n/x"]
    assert [plain_uri(u) for u in names] == ["s3://b/x y", "s3://b/x", "/dbfs/mnt/a", "file:///tmp/a", "/tmp/a", "abfss://c@h/x", "abfss://c@h/x", "hdfs://n/x"]


# --- nearest neighbours


def vectors(spark, extra=()):
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, 16))
    data = [(i, [float(x) for x in centres[i % 6] + 0.4 * r.standard_normal(16)]) for i in range(600)]
    data += [(600 + i, data[10][1]) for i in range(50)]
    return data, spark.createDataFrame([*data, *extra], "vec_id long, embedding array<double>")


def test_nearest(spark):
    bad = [(900, None), (901, [0.0] * 16), (920, [float("nan")] + [1.0] * 15), (940, [float("inf")] + [1.0] * 15), (960, [None] + [1.0] * 15), (None, [1.0] * 16)]
    data, df = vectors(spark, bad)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block_rows=128).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    ids, X = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = X @ X[q]
        order = [int(ids[k]) for k in np.lexsort((ids, -np.round(scores, 9))) if ids[k] != q][:20]
        hits += len(set(order) & {v for v, _, _ in found})
        assert [f[2] for f in found] == list(range(1, 21)) and all(abs(s - scores[v]) < 1e-9 for v, s, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_with_few_rows(spark):
    _, df = vectors(spark)
    assert ann.nearest(df.limit(0), F.lit(True), 5).count() == 0
    few = ann.nearest(df.where("vec_id < 4").withColumns({"id": F.lit(1), "leaf": F.lit(2), "block": F.lit(3)}), F.lit(True), 20)
    assert few.groupBy("query_id").count().where("count = 3").count() == 4


@pytest.mark.parametrize("scale", [1e-120, 1e-6, 1.0, 1e6, 1e120])
def test_nearest_at_any_magnitude(spark, scale):
    """The same vectors times a power of two nearby: the same neighbours."""
    unit = 2.0 ** round(np.log2(scale))
    r = np.random.default_rng(9)
    X = r.standard_normal((400, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v * unit]) for i, v in enumerate(X)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for row in ann.nearest(df, F.col("vec_id") % 40 == 0, 20, confidence=0.999, block_rows=100).collect():
        found[row["query_id"]].add(row["vec_id"])
    hits = sum(len(found[q] & set(sorted((i for i in range(400) if i != q), key=lambda i: -(X[i] @ X[q]))[:20])) for q in range(0, 400, 40))
    assert hits >= 0.97 * 200


def test_many_equal_vectors_and_other_lengths(spark):
    equal = [(i, [1.0, 2.0, 3.0]) for i in range(3000)]
    odd = [(5000, [1.0, 2.0]), (5020, [9.0] * 4), (5001, [])]
    df = spark.createDataFrame(equal + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 500 == 20, 20, block_rows=256).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {20, 520, 1020, 1520, 2020, 2520}
    assert all(v == [i for i in range(22) if i != q][:20] for q, v in got.items())


def test_near_ties_are_ordered_exactly(spark):
    """Products that differ in the last bits only."""
    r = np.random.default_rng(11)
    base = r.standard_normal(16)
    X = np.array([base * (1 + k * 2.0**-52) for k in range(300)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "vec_id long, embedding array<double>")
    got = [(x["vec_id"], x["score"]) for x in ann.nearest(df, F.col("vec_id") == 0, 20, block_rows=64).orderBy("rank").collect()]
    scores = {i: ann.product(X[i], X[0]) for i in range(1, 300)}
    assert got == [(i, scores[i]) for i in sorted(scores, key=lambda i: (-scores[i], i))[:20]]


def test_the_sample_reaches_the_driver_projected(spark, monkeypatch):
    """The driver's share of a fit does not grow with the vectors' width."""
    width, count, seen = 300, 400, []
    X = np.random.default_rng(9).standard_normal((count, width))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, w array<double>").cache()
    kind = type(rows)
    collect, arrow = kind.collect, kind.toArrow

    def collected(self):
        got = collect(self)
        seen.append(8 * sum(len(r["w"]) for r in got))
        return got

    def as_arrow(self):
        got = arrow(self)
        seen.append(got.nbytes)
        return got

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toArrow", as_arrow)
    largest = float(np.sqrt((X**2).sum(axis=1)).max())
    tree = ann.fit(rows, count, width, largest, 8, 64)
    assert 0 < sum(seen) <= count * 8 * 8 and tree.leaves == 4
    points = ann.Tree(tree.directions, largest, []).project(X, True)
    dim, value = tree.splits[0]
    assert dim == np.argmax(np.ptp(points, axis=0)) and value == pytest.approx(np.median(points[:, dim]))
    assert np.bincount(tree.leaf(points), minlength=4).tolist() == [100] * 4


def test_chi_square():
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and ann.chi2_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)


# --- language


def test_automaton_accepts_exactly_the_substrings():
    sample = [1, 2, 1, 2, 2, 3, 1, 2]
    moves = langid.suffix_automaton(sample)
    subs = {tuple(sample[i:j]) for i in range(8) for j in range(i, 9)}

    def accepts(word):
        at = 0
        for s in word:
            if s not in moves[at]:
                return False
            at = moves[at][s]
        return True

    from itertools import product

    assert all(accepts(w) == (w in subs) for n in range(5) for w in product((1, 2, 3), repeat=n))


def test_phrases_equal_greedy_parsing():
    sample, text = b"the cat sat on the mat and the dog", b"the dog and a cat on that mat zzz" * 60
    model = langid.Model.of(sample)
    norm = bytes(langid._symbols(sample))

    def greedy(seg):
        n = at = 0
        while at < len(seg):
            k = at + 1
            while k < len(seg) and seg[at : k + 1] in norm:
                k += 1
            at, n = (k, n + 1) if seg[at:k] in norm else (at + 1, n + 1)
        return n

    symbols = langid._symbols(text)
    want = sum(greedy(bytes(symbols[a : a + langid.SEGMENT])) for a in range(0, len(text), langid.SEGMENT))
    got = langid.rates({"x": model}, [text.decode()])[0, 0] * len(text) / model.bits
    assert abs(got - want) <= 2 * (1 + len(text) // langid.SEGMENT)


def test_languages(spark, docs, crowded, empty):
    tables = {"aa": "kata mori sano belu".split(), "bb": "thwack grunch spliff brond".split()}
    r = np.random.default_rng(1)
    data = [(i, " ".join(r.choice(tables[k], 30)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = langid.predict(df, langid.learn(df))
    held = out.where(~langid.learnable(F.col("doc_id")))
    assert held.count() > 40 and held.where("lang = _lid_lang").count() == held.count()
    assert out.where("_lid_score < 0 or _lid_score > 1").count() == 0
    got = {r["doc_id"]: r["_lid_lang"] for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert got[26] == got[27] == got[28] == got[33] == "und" and got[29] != "und" and got[30] != "und"
    assert langid.predict(crowded, langid.learn(crowded)).columns == [*crowded.columns, "_lid_lang", "_lid_score"]
    assert langid.learn(empty) == {} and langid.predict(empty, {}).count() == 0
    assert langid.predict(docs, {}).where("_lid_lang <> 'und'").count() == 0


# --- mixing


def test_poisson_counts(spark):
    from math import exp, factorial

    us = [i / 997 for i in range(997)]
    df = spark.createDataFrame([(u, rate) for u in us for rate in (0.3, 1.0, 3.7)], "u double, rate double")
    for r in df.withColumn("n", mixing.poisson_count(F.col("rate"), F.col("u"))).collect():
        c, n = exp(-r["rate"]), 0
        while c <= r["u"]:
            n += 1
            c += exp(-r["rate"]) * r["rate"] ** n / factorial(n)
        assert r["n"] == n


def test_distributions_are_those_added_up(spark):
    us = [i / 997 for i in range(997)] + [1 - 2.0**-52]
    df = spark.createDataFrame([(u, rate) for u in us for rate in (0.01, 0.3, 1.0, 3.7, 40.0)], "u double, rate double")
    looked_up = F.size(F.filter(mixing.distribution(F.col("rate")), lambda c: c <= F.col("u")))
    assert df.where(looked_up != mixing.poisson_count(F.col("rate"), F.col("u"))).where("u < 0.999").count() == 0


def test_mixing_is_globally_ordered(spark):
    many = spark.createDataFrame([(i, "x", f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.replicate(many).withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in out}) == 4
    assert [r["_mix_key"] for r in sorted(out, key=lambda r: r["p"])] == sorted(r["_mix_key"] for r in out)


def test_mixing_with_names_of_its_own_and_a_shuffled_join(spark, docs, monkeypatch):
    clash = docs.selectExpr("*", "1 as _mix_rate", "'a' as _mix_copy", "2 as _mix_of", "3 as _mix_u")
    want = mixing.replicate(docs).select(*docs.columns)
    assert mixing.replicate(clash).columns[: len(clash.columns)] == clash.columns
    assert mixing.replicate(clash).select(*docs.columns).exceptAll(want).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.replicate(docs).select(*docs.columns).exceptAll(want).count() == 0


def test_mixing(spark, docs, crowded, empty):
    many = spark.createDataFrame([(i, "x" * 100, "big" if i % 10 else "small") for i in range(20_000)], "doc_id long, text string, source string")
    out = mixing.replicate(many)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["small"] / sum(n.values()) == pytest.approx(0.25, abs=0.02) and sum(n.values()) == pytest.approx(20_000, rel=0.05)
    assert out.groupBy("doc_id", "_mix_copy").count().where("count > 1").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.replicate(many.repartition(7)).collect()))
    assert mixing.replicate(empty).count() == 0 and mixing.replicate(crowded).columns[: len(crowded.columns)] == crowded.columns
    assert mixing.replicate(docs).select(*docs.columns).exceptAll(mixing.replicate(docs).select(*docs.columns)).count() == 0


# --- sharding


def test_shards(spark, docs, crowded, empty):
    out = sharding.kd_shards(docs, 5).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows())
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    sizes = {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == sizes
    assert sharding.kd_shards(empty, 5).count() == 0 and sharding.kd_shards(crowded, 5).count() == len(out)


def test_shards_are_even_and_hold_equal_texts_together(spark):
    texts = [(i, prose(i, 5 + i * 7 % 200)) for i in range(1500)] + [(2000 + i, prose(i // 3, 5 + i // 3 % 5)) for i in range(300)] + [(3000 + i, "hot text " * 30) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = sharding.kd_shards(df, 16)
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) / (sum(sizes) / 16) < 1.03 and min(sizes) / (sum(sizes) / 16) > 0.97
    hot = zlib.crc32(("hot text " * 30).encode())
    assert out.where(F.col("text_crc32") != hot).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_shards_of_the_test_tables(spark, sf):
    """Near-equal bytes also where one document weighs half a shard, and no group of equal texts is torn."""
    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test tables")
    shards = 40 if sf == "0.01" else 8
    out = sharding.kd_shards(spark.read.parquet(path), shards).toPandas()
    weights = out.groupby("shard")["size"].sum()
    assert len(weights) == shards and weights.max() / weights.mean() < 1.03 and weights.min() / weights.mean() > 0.97
    assert out.groupby(["text_crc32", "size"])["shard"].nunique().max() == 1


def test_the_tree_cuts_at_the_weighted_median(spark):
    """Two shards of light texts: a cut of the widest dimension at the nearest bin to half of the weight, by brute force."""
    r = np.random.default_rng(2)
    texts = [(i, "x" * int(n) + "\n" * int(n % 3)) for i, n in enumerate(r.integers(1, 4000, 3000))]
    out = sharding.kd_shards(spark.createDataFrame(texts, "doc_id long, text string"), 2).toPandas()
    size = {s: g["size"] for s, g in out.groupby("shard")}
    assert size[0].max() <= size[1].min() + 4 and abs(size[0].sum() - size[1].sum()) <= 2 * 4020


def test_value_classes_are_ordered(spark):
    df = spark.range(0, 70_000).select(F.col("id").alias("v")).union(spark.createDataFrame([((1 << k) + d,) for k in range(17, 31) for d in (-1, 0, 1)], "v long"))
    got = [tuple(r) for r in df.select("v", sharding.value_class("v").alias("c")).orderBy("v").collect()]
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and len({c for _, c in got}) < 6000
    assert [c for v, c in got[:256]] == list(range(256))


def test_heavy_groups_fill_up_to_the_level():
    group = lambda w, k, n=1: {"w": w, "n": n, "_kd_crc": k, "_kd_bytes": 1}
    given, wants = sharding._deal_heavy([group(90, 0), group(60, 1), group(30, 2), group(500, 3, 50)], 1000, 4)
    assert [g for g in given if g[0] == 3] == [(3, 1, 0, 25, 0), (3, 1, 25, 50, 1)] and (0, 1, 0, 1, 2) in given
    assert wants == [0.0, 0.0, 160.0, 160.0]
    assert sharding._deal_heavy([], 0, 3) == ([], [0.0, 0.0, 0.0])
    assert sharding._deal_heavy([group(10, 1)], 12, 1) == ([(1, 1, 0, 1, 0)], [2.0])
    given, wants = sharding._deal_heavy([group(900, 1), group(50, 2, 5)], 1000, 2)  # one text heavier than a shard
    assert given == [(1, 1, 0, 1, 0), (2, 1, 0, 5, 1)] and wants == [0.0, 50.0]


def test_one_row_many_times(spark):
    """A group that outweighs a shard is torn evenly, even if its rows are all the same."""
    df = spark.createDataFrame([(5, "same " * 20)] * 4000 + [(i, prose(i, 8)) for i in range(100)], "doc_id long, text string")
    out = sharding.kd_shards(df, 8).toPandas()
    weights = out.groupby("shard")["size"].sum()
    assert len(weights) == 8 and weights.max() / weights.mean() < 1.03 and weights.min() / weights.mean() > 0.97
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_write_shards(docs, tmp_path, spark):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)


def test_shared_folder(spark):
    from tidelog.llm.common import materialize, release, shared_dir

    made = materialize(spark.range(5).toDF("a"), "numbers")
    assert made.count() == 5 and shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/tidelog/x-")
    assert release(spark) >= 1 and release(spark) == 0
