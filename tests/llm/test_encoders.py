"""Vector codes, fill-in-middle and the web archive on small awkward tables, against plain versions."""

import gzip
import hashlib
import uuid

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from bindlattice.llm import fill_middle, vector_codes, warc_store

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes, errors and codebooks by Python integers and full searches."""
    kept = [(i, [int(np.floor(x * scale)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def ordered(rows):
    return sorted(rows, key=str)


def check_codes(spark, rows, **settings):
    frame = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).withColumn("vector", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)
    coded, books = vector_codes.compress_vectors(frame, **settings)
    expected, plain_books = plain_codes(rows, **settings)
    assert ordered((r["vec_id"], r["label"], r["code"], r["error"]) for r in coded.collect()) == ordered(expected)
    assert [b.tolist() for b in books if b.size] == [b for b in plain_books if b and b[0]]


def test_vector_codes(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(0, 0.2, 16).round(2).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]  # one vector many times
    rows += [(None, rows[1][1], 2), (3, rows[2][1], 2), (3, rows[2][1], 2), (2000, None, 1), (2001, [1.0, None] * 8, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] * 16, 1)]
    check_codes(spark, rows)
    check_codes(spark, rows, entries=5, rounds=2)


def test_vector_codes_of_odd_tables(spark):
    check_codes(spark, [])
    check_codes(spark, [(1, None, 1)])
    check_codes(spark, [(1, [], 1), (2, [], None)])
    check_codes(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25, -0.125, 0.0, 1.0], 1), (3, [], 1)])
    # Far beyond what double precision can tell apart.
    big = [(i, [1e9 * (i % 7) + j, -2.0**37, 3.0 * i, 1e-9] * 2, i % 2) for j, i in enumerate(range(30))]
    check_codes(spark, big, entries=8)


def test_search_by_tree_keeps_ties():
    rng = np.random.default_rng(4)
    for size, high in ((1, 2), (2, 3), (16, 2), (16, 40)):
        entries = rng.integers(-high, high, (256, size))
        points = np.concatenate((rng.integers(-high - 2, high + 2, (3000, size)), entries))
        away = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        for leaf in (1, 3, 32):
            found, best = vector_codes.Search(entries, leaf=leaf).nearest(points)
            assert (found == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


@pytest.fixture(scope="module")
def texts():
    long = "\n".join(f"line {i} é \U0001f600" for i in range(20_000))
    return [
        (1, None), (2, ""), (3, "\n"), (4, "\n\n\nx"), (5, "one line"), (6, "has <P> in it"), (7, "a\nb\nc\n"), (8, "a\r\nb c\x0bd\n\n"), (9, long), (9, long), (9, "other\ntext"),
        (None, "no id\nat all\n"), (None, "no id\nat all\n"), (10, "<\nP>\n<S\n>\n<M"), (-11, "negative\n<\n"), (12, "é\né\né"), (13, "<M>"), *((100 + i, "\n".join("abcdefgh"[: i % 9])) for i in range(60)),
    ]


def plain_middle(key, text, seed, rate, spm_share):
    text = text or ""
    units = regex.findall(fill_middle.UNIT, text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < spm_share else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if h4 % 100 < spm_share else "psm", len(prefix), len(middle), out


@pytest.mark.parametrize(("seed", "rate", "spm_share"), [(7, 100, 50), (3, 60, 20)])
def test_fill_in_middle(spark, texts, seed, rate, spm_share):
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("cut", F.lit(1))
    got = fill_middle.fill_in_middle(frame, seed=seed, rate=rate, spm_share=spm_share).collect()
    expected = [(i, *plain_middle(i, t, seed, rate, spm_share)) for i, t in texts]
    assert ordered(map(tuple, got)) == ordered(expected)
    digests = fill_middle.fill_in_middle_digests(frame, seed=seed, rate=rate, spm_share=spm_share).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert ordered(map(tuple, digests)) == ordered((*e[:5], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, texts, strict=True))
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.fixture(scope="module")
def pages():
    big, other = "<p>é</p>" * 200, "x" * 1000
    return [
        (1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c\r\nWARC-Type: revisit", other), (4, "http://d", "x" * 999), (5, "http://d", "x" * 999), (6, "", None), (7, None, ""),
        (8, "u", "a\r\n\r\nb\x00" * 300), (None, "n", big), (None, "n", "only nulls" * 200), (10, "r", "twice" * 300), (10, "r", "twice" * 300), (2, "again", "twice" * 300), (-4, "v", "z" * 2_000_000),
        *((100 + i, "hot", "copy" * 400) for i in range(300)),
    ]


def plain_records(pages):
    rows = []
    for i, _, html in pages:
        raw = (html or "").encode()
        alike = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
        top = max(alike, default=None)
        follows = len(raw) >= 1000 and i != top
        rows.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if follows else "response", top if follows else None))
    return ordered(rows)


def archive(spark, pages):
    path = f"file:///tmp/checkpoints/test-archive-{uuid.uuid4().hex}"
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("address", F.lit("clash")).withColumn("salt", F.lit(3)).repartition(6)
    warc_store.write_archive(frame, path)
    return path


@pytest.mark.parametrize("share", [1000, 7])
def test_archive(spark, pages, share, monkeypatch):
    monkeypatch.setattr(warc_store, "SHARE", share)
    path = archive(spark, pages)
    assert ordered(tuple(r)[:5] for r in warc_store.read_archive(spark, path).collect()) == plain_records(pages)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    whole = warc_store.reconstruct(spark, path).collect()
    assert ordered((r["page_id"], bytes(r["payload"])) for r in whole) == ordered((i, (h or "").encode()) for i, _, h in pages)


def parsed(data):
    """Records of WARC bytes: header fields and block, by the stated lengths alone."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        assert len(fields) == len(lines)
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        assert len(block) == int(fields["Content-Length"])
        at = end + 4 + len(block)
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        out.append((fields, block))
    return out


def test_archive_files(spark, pages, tmp_path):
    path = archive(spark, pages)
    warc_store.export_warc(spark, path, f"file://{tmp_path}/files")
    records = [r for f in sorted((tmp_path / "files").glob("part-*")) for r in parsed(gzip.decompress(f.read_bytes()))]
    got = []
    for fields, block in records:
        number = lambda name: None if fields[name] == "<urn:x-page:null>" else int(fields[name].removeprefix("<urn:x-page:").removesuffix(">"))  # noqa: B023, E731
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n")
        size = int(head.rpartition(b": ")[2])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            assert (size, digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        else:
            assert payload == b"" and "WARC-Profile" in fields
        got.append((number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To") if "WARC-Refers-To" in fields else None))
    assert ordered(got) == plain_records(pages)


def test_damaged_payloads_stop_the_reader(spark, pages):
    path = archive(spark, pages)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}/bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/bad/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc_store.read_archive(spark, f"{path}/bad").collect()


def test_empty_archive(spark):
    path = archive(spark, [])
    assert warc_store.read_archive(spark, path).count() == 0 and warc_store.reconstruct(spark, path).count() == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_middle", "op13_warc"])
def test_matches_oracle(spark, sf, oracle, name):
    from bindlattice.llm.registry import ORACLE_SQL, QUERIES

    frames = QUERIES[name](spark, sf).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    a, b = ([tuple("" if pd.isna(v) else f"{v:.0f}" if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)] for f in frames)
    assert sorted(a) == sorted(b)
