"""The ten corpus operators on small awkward tables, against brute force."""

import collections
import hashlib
import math
import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindlattice.llm import chat_format, decontaminate, html_extract, lm_score, mixing, near_dedup, quality, token_files, topk_search, toxicity
from bindlattice.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
BASE = " ".join(f"base{i}" for i in range(120))


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (5, "ONE two", "b"), (6, BASE, "a"), (7, BASE.replace("base60", "other"), "a"),
            (8, BASE + " tail", None), (9, LONG, "c"), (10, LONG, "c"), (10, LONG, "c"), (None, BASE, "a"), (11, "x\x00y z", "b"), (12, "é É ü ü", "b")]
    return rows, spark.createDataFrame(rows, DOCS)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, awkward, percent):
    rows, frame = awkward
    rng = np.random.default_rng(3)
    for g in range(3):
        base = [f"g{g}x{i}" for i in range(80)]
        for k in range(12):
            copy = list(base)
            for at in rng.integers(0, 80, int(rng.integers(0, 6))):
                copy[at] = f"e{g}{k}{at}"
            rows = [*rows, (100 + 20 * g + k, " ".join(copy), "d")]
    frame = spark.createDataFrame(rows, DOCS)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {i: [s for s in (shingles(r[1]) for r in rows if r[0] == i) if s] for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = near_dedup.near_duplicates(frame, percent=percent).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((r[0] or -1, len(shingles(r[1]))) for r in rows)
    for r in got:
        assert (r["component_id"], r["kept"]) == ((None, False) if r["doc_id"] is None else (find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert token_files.tokens_of(docs).count() == 0
    assert lm_score.score_documents(docs, F.lit(False)).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == 0
    assert quality.score_quality(docs, labels).count() == 0
    assert decontaminate.contained_items(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert topk_search.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "tree long, node long, parent long, score double, role string, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_sequential_test_bounds():
    low = near_dedup.least_matches(0.85, 1e-6, [28, 140])
    assert 10 < low[0] < 20 and 80 < low[1] < 119


def test_mixing(spark, awkward):
    rows, frame = awkward
    rows = rows + [(1000 + i, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(900)]
    frame = spark.createDataFrame(rows, DOCS)
    got = [r.asDict() for r in mixing.mix(frame).collect()]
    assert len(got) == len(rows) and all(len(r["copies"]) <= 2 for r in got)
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * len(r["copies"])
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in got if r["source"] == s)
    again = sorted((r["doc_id"] or -1, str(r["copies"])) for r in mixing.mix(frame.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, str(r["copies"])) for r in got)


def test_splitting_tree_is_exact_and_even(spark):
    slots = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("source"), F.lit(0).alias("epoch"), F.col("id").alias("block"))
    tree = mixing.split_blocks(slots, 8, 1).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.when(F.col("source").isNull(), 1).otherwise(0)).alias("nulls")).collect()
    assert sorted(r["n"] for r in tree) == [625] * 8
    assert all(150 < r["nulls"] < 270 for r in tree)


def test_token_files_round_trip(spark, awkward):
    from tokenizers import Tokenizer

    rows, frame = awkward
    rows = [*rows, (13, "Word, word. <|endoftext|>, <|EndOfText|> it's 12. a.b É.", "b")]
    frame = spark.createDataFrame(rows, DOCS)
    encoder = Tokenizer.from_file(token_files.default_tokenizer())
    expected = sorted((-1 if r[0] is None else r[0], tuple(encoder.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    path = "file:///tmp/checkpoints/test-tokens-" + hashlib.md5(str(id(frame)).encode()).hexdigest()
    token_files.write_token_files(frame, path)
    got = [(r["doc_id"], r["start"], r["ids"]) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    assert sorted((-1 if d is None else d, tuple(ids)) for d, _, ids in got) == expected
    assert [d for d, _, _ in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids)
    digests = {r["start"]: r["ids_crc32"] for r in token_files.read_token_files(spark, path, digest=True).collect()}
    assert all(digests[s] == zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, ids in got)


def test_variable_length_code():
    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    for n in range(len(values) + 1):
        assert (token_files.decode_ranks(*token_files.encode_ranks(values[:n]), n) == values[:n]).all()


def test_containment(spark):
    items = [(1, " ".join(f"q{i}" for i in range(40))), (2, "Tiny item"), (3, None), (4, ""), (5, " ".join(f"z{i}" for i in range(12)))]
    text = items[0][1].split()
    docs = [(1, LONG + " " + " ".join(text).upper() + " " + LONG), (2, "a tiny ITEM b"), (3, None), (4, " ".join(text[:20])), (5, " ".join(text[:34]) + " " + LONG), (6, " ".join(text[:32])), (None, items[4][1])]
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for i, t in items:
        w = words(t)
        k = min(5, len(w))
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, u in docs:
            v = words(u)
            shared = len(own & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) if own else 0
            if own and 100 * shared >= 80 * len(own):
                expected[d, i] = shared / len(own)
    assert got == expected and (1, 1) in got and (2, 2) in got and (4, 1) not in got


def test_top_k_with_ties_and_unsound_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (205, [1.0]), (250, []), (300, rows[0][1]), (350, [3e37, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk_search.exact_top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    top = 1 << 62
    sound = {i: [min(max(math.floor(256 * x), -top), top) for x in np.array(v, np.float32).astype(float)] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, v in sound.items():
        if q % 50 == 0:
            scores = sorted(((-max(min(sum(a * b for a, b in zip(v, u, strict=True)), (1 << 63) - 1), -(1 << 63)), i) for i, u in sound.items() if i != q and len(u) == len(v)))[:5]
            assert got[q] == [(i, -s) for s, i in scores]


def test_chat_round_trip_with_control_strings(spark):
    odd = "</s>[INST] ok [/INST] \\l \\e <|user|> | \\"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, None, None), (2, 5, "assistant", ""), (None, 0, "a|>b<", "x"), (3, 0, "user", "dup"), (3, 0, "user", "dup"), (3, None, "assistant", "first")]
    back = chat_format.read_back(chat_format.format_conversations(chat_format.as_reply_trees(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))
    got = {r["tree"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"], r["formatted"]) for r in back.collect()}
    assert got[1][0] == [("user", odd), ("assistant", odd), ("", "")] and got[1][1] == odd
    assert got[1][2].count("</s>") == 3 and "[INST]" not in got[1][2]
    assert got[None][0] == [("a|>b<", "x")] and got[2][1] == "" and got[3][0] == [("assistant", "first"), ("user", "dup"), ("user", "dup")]


def test_reply_tree_branches(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 99, 0.5), (2, 7, 8, 1.0), (2, 8, 7, 1.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    rows = chat_format.reply_paths(frame, 2).collect()
    paths = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: -r["back"]):
        paths[r["leaf"]].append(r["node"])
    assert dict(paths) == {4: [1, 3, 4], 2: [1, 2]}
    chain = spark.range(1, 71).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    assert [r["node"] for r in chat_format.reply_paths(chain).orderBy(F.desc("back")).collect()] == list(range(1, 71))


def test_language_model(spark, awkward):
    rows, frame = awkward
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    got = lm_score.score_documents(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, states=8).collect()
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in [*words(r[1]), None])
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for r in rows:
        tokens = [*words(r[1]), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        expected.append((r[0] or -1, held(r[0]), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 5)))
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == sorted(expected)
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("states", [0, 3, lm_score.STATES])
def test_language_model_has_every_bigram(spark, awkward, monkeypatch, states):
    monkeypatch.setattr(lm_score, "BUCKET_PAIRS", 10_000)
    rng = np.random.default_rng(5)
    # 3,000 kinds of tokens, more than STATES, half of them seldom.
    extra = [(1000 + i, " ".join(f"t{int(x)}" for x in rng.integers(0, 3000, 120) ** rng.choice([1.0, 0.7], 120)), "z") for i in range(300)]
    rows = [*awkward[0], *extra]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    got = lm_score.score_documents(spark.createDataFrame(rows, DOCS).repartition(5), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, states=states).collect()
    single, pairs, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in rows:
        tokens = [*words(r[1]), None]
        if not held(r[0]):
            for a, b in zip([None, *tokens], tokens, strict=False):
                single[b] += 1
                pairs[a, b] += 1
                after[a].add(b)
    total, kinds, d = sum(single.values()), len(single), lm_score.DISCOUNT
    assert kinds > lm_score.STATES

    def chance(a, b):
        alone = max(single[b] - d, 0) / total + d * kinds / total / (kinds + 1)
        return max(pairs[a, b] - d, 0) / single[a] + d * len(after[a]) / single[a] * alone if single[a] else alone

    expected = []
    for r in rows:
        tokens = [*words(r[1]), None]
        expected.append((r[0] or -1, len(tokens), sum(math.log10(chance(a, b)) for a, b in zip([None, *tokens], tokens, strict=False))))
    found = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in got)
    assert len(found) == len(expected)
    for x, y in zip(found, sorted(expected), strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 * max(1.0, abs(y[2]))


def test_automaton_is_a_distribution():
    counts = np.array([[4, 1, 0], [0, 3, 2], [1, 0, 0], [2, 2, 0]])
    arcs = np.flatnonzero(counts)
    a = lm_score.Automaton(arcs, counts.reshape(-1)[arcs], 2, 7)
    for state in range(4):
        total = sum(10 ** a.step(np.array([state]), np.array([c]))[0][0] for c in range(3))
        assert abs(total - 1) < 1e-9
    own = a.emission(np.full(6, 2), np.array([1, 0, 0, 0, 0, 0]))
    assert (own < 0).all()


def test_toxicity_and_quality_learn(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [(-1, None), (-2, "")], []
    for i in range(400):
        text = list(rng.choice(plain, int(rng.integers(20, 60))))
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            text[int(rng.integers(0, len(text)))] = "dreadfulness"
        if junk:
            text = [text[0]] * len(text) if not bad else [*text[:1] * 30, "dreadfulness"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(bad)))
    labels += [(None, 1, 1), (5000, None, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for k, result in ((1, toxicity.score_toxicity(docs, known)), (0, quality.score_quality(docs, known))):
        got = result.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        held = [r for r in got if r["held_out"] and r["doc_id"] >= 0]
        assert sum(r["predicted"] == truth[r["doc_id"]][k] for r in held) >= 0.95 * len(held)


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs, one).collect()} == {1.0}


PAGE = "<html><head><title>x</title><script>var a='</p>'</script></head><body><nav><a href=/>Menu</a></nav>{}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        (PAGE.format("<article><h1>T</h1><p><b>One<br>two<p>th<i>re</i>e</article><div class='comments'>no</div>"), "T One two three"),
        (PAGE.format("<div id=content><p>A long enough paragraph of text, with words.</p><p>More &lt;text&gt; here, and words.</p></div><div class=sidebar><p>no</p></div><form>no</form>"), "A long enough paragraph of text, with words. More <text> here, and words."),
        ("<p>a</p></div></span><p>b", "a b"), ("<!-- x --><p title=\"a>b\">c</p>", "c"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"
    assert len(html_extract.main_text("<p>" + "word " * 100_000)) == 499_999


def test_extra_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s", 9, 9, "k")], "doc_id long, text string, source string, component_id long, size long, `a.b` string")
    assert near_dedup.near_duplicates(docs).first()["component_id"] == 1
    assert mixing.mix(docs).first()["size"] == 6
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert token_files.tokens_of(docs).count() == 1


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = step(spark, docs, sf)
        if name == "token_files":
            assert docs.count() == before.count()
        else:
            assert docs.columns == before.columns and 0 < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]


def test_words_of_arrow_slices():
    column = pa.array(["a b", None, "c"]).slice(1)
    from bindlattice.llm import textkit

    raw, offsets = textkit.buffers(column)
    assert bytes(raw) == b"c" and offsets.tolist() == [0, 0, 1]


STORY = "<p>" + "The story goes on and on. " * 20 + "</p>"
SAID = " ".join(["The story goes on and on."] * 20)


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>t</title><meta charset=utf-8><body><article>{STORY}</article></body></html>",
        f"<html><head><title>t</title><div>{STORY}</div></html>",
        f"<head><link rel=x href=y>{SAID}",
        f"<body><div class='has-sidebar'><article>{STORY}</article><div class='sidebar'>other words</div></div></body>",
        f"<body><div id='ad-free'><div class='content-with-sidebar'>{STORY}</div></div><p class='related'>see also</p></body>",
        f"<body><main>{STORY}<div class='comments'><article class='comment'><p>I say no</p></article></div></main></body>",
        f"<body><article>{STORY}</article><div class='related'><article><p>teaser words</p></article></div></body>",
    ],
)
def test_articles_in_open_heads_and_named_wrappers(html):
    assert html_extract.main_text(html) == SAID


def _plain_densities(page):
    """Density sums by their definition: every block's counts are summed over its descendants anew."""
    n = len(page.tag)
    children = [[j for j in range(1, n) if page.parent[j] == i] for i in range(n)]

    def below(i):
        return [i] + [k for j in children[i] for k in below(j)]

    def counts(i):
        return [sum(getattr(page, name)[k] for k in below(i)) for name in ("chars", "tags", "link_chars", "link_tags")]

    body = page.tag.index("body")
    all_chars, _, all_links, _ = counts(body)

    def density(i):
        c, t, lc, lt = counts(i)
        if not c:
            return 0.0
        inner = c / max(c - lc, 1) * lc + all_links / max(all_chars, 1) * c + math.e
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(math.log(math.log(inner)), 1e-2)

    return body, [density(i) for i in range(n)], [sum(density(j) for j in children[i]) * (html_extract.LANDMARK if page.tag[i] in ("article", "main") else 1) for i in range(n)]


def test_densities_against_their_definition():
    rng = np.random.default_rng(2)

    def tree(depth):
        tag = str(rng.choice(["div", "section", "p", "ul", "article"]))
        inner = "".join(tree(depth - 1) for _ in range(int(rng.integers(0, 4)))) if depth and tag != "p" else ""
        link = f"<a href=x>{'l' * int(rng.integers(1, 9))}</a>" if rng.random() < 0.4 else ""
        return f"<{tag}>{'w ' * int(rng.integers(0, 60))}{link}<b>b</b>{inner}</{tag}>"

    for _ in range(40):
        page = html_extract._parse(f"<body>{''.join(tree(3) for _ in range(4))}</body>")
        body, density, total = html_extract._densities(page)
        plain = _plain_densities(page)
        assert body == plain[0] and np.allclose(density, plain[1]) and np.allclose(total, plain[2])
        keep = html_extract._content(page)
        assert keep[max(range(1, len(total)), key=lambda i: (plain[2][i], -i))]


PROSE = "A sentence of several words, then another one that is longer. " * 6


@pytest.mark.parametrize(
    "around",
    [
        "<div class=x1><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></div>{}<div class=x3>Buy our new thing today.</div>",
        "<div><a href=/a>Home</a> <a href=/b>News</a></div><div><div>{}</div></div><div><p>Buy.</p></div>",
    ],
)
@pytest.mark.parametrize("box", ["article", "main", "div"])
def test_density_decides_without_names(around, box):
    inner = f"<section id=search-theory><h2>Theory</h2><p>{PROSE}</p></section><div class=related-work><p>{PROSE}</p><p>Short.</p></div><ul><li>a</li><li>b</li></ul>"
    page = f"<body>{around.format(f'<{box}><h1>Title</h1><p>{PROSE}</p>{inner}</{box}>')}</body>"
    said = " ".join(PROSE.split())
    assert html_extract.main_text(page) == f"Title {said} Theory {said} {said} Short. a b"


_SAYS = "<h2>Comments</h2><p>First reader says this is a fine text.</p><p>Second reader does not agree.</p>"
_COOKIES = "We use cookies and other means to make this page work. " * 60


@pytest.mark.parametrize(
    ("before", "inside", "after", "more"),
    [
        ("", "<div><div><p>Fig.</p></div></div>", "", " Fig."),
        ("", f"<section class='comments'>{_SAYS}</section>", "", ""),
        ("", f'<section class="Comments open"><div><div>{_SAYS}</div></div></section>', "", ""),
        ("", f"<div id=comments-section>{_SAYS}</div>", "", ""),
        ("", "", f"<div class='comments'>{_SAYS}</div>", ""),
        (f"<div class='cookie-notice'><p>{_COOKIES}</p><p>More.</p></div>", "", "", ""),
        (f"<div><p>{_COOKIES}</p></div>", "", "", ""),
        ("", "", "<article><h2>More</h2><p>Another short one.</p></article>", " More Another short one."),
        ("<div class='ad'>Buy this.</div>", "<p class='commentary'>Not a comment.</p>", "<div class=sidebar-widget>Other words.</div>", " Not a comment."),
    ],
)
@pytest.mark.parametrize("box", ["article", "div"])
def test_articles_stay_whole_and_alone(before, inside, after, more, box):
    if box == "div" and (_COOKIES in before and "class" not in before or "<article>" in after):
        pytest.skip("nothing tells a nameless notice, or a second text, from the first")
    html = f"<body><nav><a href=/>Home</a></nav>{before}<{box}><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>{inside}</{box}>{after}<footer>End</footer></body>"
    said = " ".join(PROSE.split())
    assert html_extract.main_text(html) == f"Title {said} {said}{more}"


@pytest.mark.parametrize("html", ["<a " * 30_000, "<div><p>" * 10_000, "<b>" * 6000 + "</i>" * 6000, "<!" * 50_000, '<a "' * 20_000 + ">", "<table>" + "<tr><td>" * 10_000])
def test_parsing_takes_linear_time(html):
    began = time.perf_counter()
    html_extract.main_text(html)
    assert time.perf_counter() - began < 5


def test_pages_with_extra_columns_and_repeats(spark):
    rows = [(1, "u", "<p>a</p>", "text"), (1, "u", "<p>a</p>", "text"), (None, None, None, None)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


def _thue_morse(n, swapped):
    return "".join("ab"[(bin(i).count("1") + swapped) % 2] for i in range(n))


def test_words_that_collide_under_polynomial_hashes(spark):
    from tokenizers import Tokenizer

    from bindlattice.llm import textkit

    pair = [_thue_morse(1024, 0), _thue_morse(1024, 1)]
    raw, offsets = textkit.buffers(pa.array(pair))
    start, end, _ = textkit.words(raw, offsets)
    assert len(set(textkit.word_hashes(raw, start, end).tolist())) == 2
    docs = spark.createDataFrame([(1, f"{pair[0]} {pair[1]}"), (2, pair[1])], "doc_id long, text string")
    encoder = Tokenizer.from_file(token_files.default_tokenizer())
    expected = {1: f"{pair[0]} {pair[1]}", 2: pair[1]}
    for r in token_files.tokens_of(docs).collect():
        ids = encoder.encode(expected[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = near_dedup.near_duplicates(docs.unionByName(spark.createDataFrame([(3, pair[0])], "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 3}


def test_equal_hashes_do_not_mix_words_up(monkeypatch):
    from bindlattice.llm import textkit

    encoder = token_files.WordEncoder(token_files.default_tokenizer())
    texts = ["one two", "Two. three, ONE", "", "é <|x|> <|X|>"]
    expected = [[*encoder._ids(t), 2] for t in texts]
    assert [x.tolist() for x in encoder.encode(pa.array(texts), 2)] == expected
    monkeypatch.setattr(textkit, "word_hashes", lambda raw, start, end, lower=True: np.full(len(start), 7, np.uint64))
    encoder._clear()
    assert [x.tolist() for x in encoder.encode(pa.array(texts), 2)] == expected


def test_word_hashes_of_all_lengths():
    from bindlattice.llm import textkit

    text = " ".join("Ab1" * n for n in range(1, 40)) + " " + " ".join("aB1" * n + "x" for n in range(1, 40))
    raw, offsets = textkit.buffers(pa.array([text, "ab1 " + "aB1" * 30]))
    start, end, before = textkit.words(raw, offsets)
    hashes = textkit.word_hashes(raw, start, end)
    assert len(set(hashes.tolist())) == 78 and hashes[before[1]] == hashes[0] and hashes[-1] == hashes[29]
    assert len(set(textkit.word_hashes(raw, start, end, lower=False).tolist())) == 80


def test_containment_counts_rows_by_themselves(spark):
    item = " ".join(f"q{i}" for i in range(40))
    half, other = item.split()[:22], item.split()[18:]
    docs = [(None, " ".join(half)), (None, " ".join(other)), (7, " ".join(half)), (7, " ".join(other)), (8, item), (8, item), (None, item)]
    items = [(1, item), (None, item)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, row long")
    got = decontaminate.contained_items(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["shared"], r["n_shingles"]) for r in got) == sorted((d, i, 36, 36) for d in (8, 8, 0) for i in (0, 1))


def test_top_k_over_many_tiles(spark, monkeypatch):
    for name, n in (("FAN", 2), ("GROUP", 2), ("SHARD", 16), ("BLOCK", 5)):
        monkeypatch.setattr(topk_search, name, n)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)], "x") for i in range(300)] + [(10, [9.0, 9.0, 9.0], "x")] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").repartition(9)
    got = collections.defaultdict(list)
    for r in topk_search.exact_top_k(frame, F.col("vec_id") % 7 == 0, k=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"], r["rank"]))
    whole = [(i, [int(256 * x) for x in v]) for i, v, _ in rows]
    for q in range(0, 300, 7):
        own = next(v for i, v in whole if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, u, strict=True)), i) for i, u in whole if i != q)[:4]
        assert got[q] == [(*s, k + 1) for k, s in enumerate(scores)]


def _targets(sizes):
    """Targets of sources by bisection of the level: min(2 * size, level * weight) sums to 1.5 of all."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, level)
    return {s: min(2 * sizes[s], low * weight[s]) for s in names}


def test_mixing_targets_follow_the_weights(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 90)), [*"abcdefg", None, "é"][int(rng.integers(0, 9))]) for i in range(700)] + [(9000, None, "a"), (9001, "w " * 5000, "b"), (None, "w", "c")]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()]
    size = collections.Counter()
    for r in rows:
        size[r[2]] += len(words(r[1]))
    expected = _targets(size)
    assert {r["source"] for r in got} == set(expected)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6 * max(1.0, expected[r["source"]])


def test_pipeline_against_plain_versions(spark, tmp_path, awkward):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(30))
    plain = [(200 + i, " ".join(f"p{i}w{k}" for k in range(60)), "a") for i in range(12)]
    rows = [*awkward[0], *plain, (300, plain[0][1], "b"), (None, plain[1][1], "b"), (None, "x " * 9 + item, "b"), (301, item.upper() + " end", "a"), (301, "only here", "a"), (302, " ".join(item.split()[:20]), "a")]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS + ", `a.b` string, _row long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    read = lambda frame: sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in frame.collect())
    steps = dict(corpus_pipeline.STAGES)
    # Without labels every score is 0.5, so nothing goes.
    assert read(steps["toxicity"](spark, docs, folder)) == read(docs)
    deduped = steps["near_dedup"](spark, docs, folder)
    assert deduped.columns == docs.columns
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    left = read(deduped)
    assert len(left) == len(groups)
    for g in groups.values():
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in g)
        assert any(d == (-1 if least[0] else least[1]) and any(t == (rows[i][1] or "") for i in g) for d, t in left)
    clean = read(steps["decontamination"](spark, docs, folder))
    own = shingles(item)
    assert clean == sorted((-1 if r[0] is None else r[0], r[1] or "") for r, s in zip(rows, sets, strict=True) if 100 * len(own & s) < 80 * len(own))
    mixed = steps["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and max(collections.Counter(read(mixed)).values()) <= 2 * 3
    assert corpus_pipeline.run(spark, folder).count() == sum(1 for _ in read(steps["mixing"](spark, steps["decontamination"](spark, deduped, folder), folder)))
    empty = docs.where("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0


def test_toxic_rows_go_whatever_their_id(spark):
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(300)]
    rows = [(i if i % 7 else None, " ".join([*rng.choice(plain, 30), "dreadfulness" if i % 4 == 0 else str(rng.choice(plain)), *rng.choice(plain, 10)]), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = toxicity.ordinary_rows(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    wrong = {r["n"] for r in kept.collect()} ^ {i for i in range(400) if i % 4}
    assert kept.columns == docs.columns and len(wrong) <= 8


def test_each_dictionary_is_needed():
    rng = np.random.default_rng(6)
    plain = [f"w{i}x{i % 7}" for i in range(400)]
    text = lambda bad: " ".join([*rng.choice(plain, 20), "abominable" if bad else str(rng.choice(plain)), *rng.choice(plain, 20)])
    found, model, _ = toxicity.fit([text(True) for _ in range(120)], [text(False) for _ in range(240)])
    fresh = pa.array([text(i < 60) for i in range(180)])
    right = lambda f: ((model.predict(np.array(list(f.features(fresh)))) >= toxicity.THRESHOLD) == (np.arange(180) < 60)).mean()
    assert right(found) > 0.95
    for side in ("ordinary", "toxic"):
        broken = toxicity.Dictionaries(b"", found.ordinary.content, found.toxic.content)
        setattr(broken, side, toxicity.Compressor(b""))
        assert right(broken) < 0.8
    # The toxic class's own part alone, behind the language that both hold, makes toxic texts known.
    shared = len(os.path.commonprefix([found.ordinary.content, found.toxic.content]))
    assert 0 < shared < len(found.toxic.content)
    bare = toxicity.Dictionaries(b"", found.ordinary.content, found.toxic.content[:shared])
    assert model.predict(np.array(list(bare.features(fresh.slice(0, 60))))).max() < toxicity.THRESHOLD


@pytest.mark.parametrize("n", [1, 2, 5, 15, 100])
def test_few_toxic_texts_train(n):
    rng = np.random.default_rng(n)
    plain = [f"w{i}x{i % 7}" for i in range(400)]
    bad = ["abominable", "dreadfulness", "horrendous"]

    def text(toxic):
        words = [str(w) for w in rng.choice(plain, 60)]
        for i in rng.choice(60, 6, replace=False) if toxic else ():
            words[i] = str(rng.choice(bad))
        return " ".join(words)

    found, model, _ = toxicity.fit([text(True) for _ in range(n)], [text(False) for _ in range(300)])
    called = lambda texts: model.predict(np.array(list(found.features(pa.array(texts))))) >= toxicity.THRESHOLD
    assert called([text(False) for _ in range(200)]).mean() <= 0.01
    if n >= 5:
        assert called([text(True) for _ in range(50)]).mean() >= 0.9


def test_toxicity_of_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    plain = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join([*rng.choice(plain, 30), "dreadfulness" if i % 4 == 0 else str(rng.choice(plain)), *rng.choice(plain, 10)])) for i in range(300)]
    long = " ".join(rng.choice(plain, 200_000))
    rows += [(1000, long), (1001, long[:500_000] + " dreadfulness" * 8 + long[500_000:]), (1002, long), (1002, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "held_out", "restart", "label", "model")})
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, known).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] in (1000, 1002)}) == 1
    assert sum(r["predicted"] != int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 300) <= 6
    again = toxicity.score_toxicity(docs.repartition(7), known).collect()
    assert sorted((r["doc_id"], r["score"]) for r in got) == sorted((r["doc_id"], r["score"]) for r in again)
