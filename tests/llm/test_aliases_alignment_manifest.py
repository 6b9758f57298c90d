"""op11 to op13 and the tile of near duplicates: fixtures with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import alignment, merkle, minhash, url_filter
from siltstone.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", ["op11_redirect_equivalence", "op13_merkle_manifest"])
def test_same_rows_as_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def fixture(tmp_path, df, view):
    """A DuckDB connection with df as a view."""
    df.write.parquet(str(tmp_path / view))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{tmp_path / view}/*.parquet'")
    return con


def head(x):
    return f"<html><head>{x}</head><body><link rel=canonical href='http://x.net/'></body></html>"


PAGES = [
    (1, "http://a.example.org/x#top", head('<link rel="Canonical other" href="/y?p=1&amp;q=2">')),
    (2, "https://B.org/1", head("<META http-equiv=refresh content='0; URL=http://c.net/z'>")),
    (3, "https://b.org/fr/1", head('<link href="../1" rel=canonical>')),
    (4, "https://b.org/2", head("<!-- <link rel=canonical href='/1'> --><link rel=canonical href='/3'>")),
    (5, "https://b.org/4", head('<script>"<link rel=canonical href=/1>"</script>')),
    (6, "https://b.org/5", head('<link rel=canonical href="3/../1">')),
    (7, None, head('<link rel=canonical href="https://b.org/1">')),
    (8, "nothing", None),
    (9, "https://b.org/3", ""),
    (9, "https://b.org/3", ""),
    (None, "http://a.example.org/y?p=1&q=2", None),
    (11, "http://www.net", "<!-- " * 3),
    (12, "http://net/", head("")),
    (13, "http://q.com/a?u=http://w.net/", head("")),
    (14, "HTTP://q.example.com/de/a", "x"),
    (15, "http://x.example.net/en/a", head('<link rel=canonical href="//B.org/1">')),
    (16, "http://z.example.net/en/b", head('<link title="rel=none" rel=canonical href=?p=2>')),
]


def test_blocks_reach_aliases_but_not_allowed_ones(spark, tmp_path, same):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("verdict", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert {k for k, r in got.items() if r.verdict == "block"} == {2, 6, 12, 14}
    assert got[6].through == "http://c.net/z" and got[3].rule == "org/fr/" and got[15].rule == "example.net/en/"
    assert (got[7].host, got[7].path, got[8].host, got[11].rule) == ("", "", "", None)
    same(url_filter.judge(pages), fixture(tmp_path, pages, "pages"), url_filter.ORACLE)
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_redirects_of_a_log_over_a_long_chain(spark):
    pages = spark.createDataFrame([(0, "http://a.org/0", None), (1, "http://a.org/40", ""), (2, "http://other.org/", "")], "page_id long, url string, html string")
    chain = spark.createDataFrame([(f"http://a.org/{i}", f"http://a.org/{i + 1}") for i in range(60)] + [("http://a.org/60", "http://spam.net/"), (None, "http://a.org/1")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, redirects=chain).collect()}
    assert got == {0: "block", 1: "block", 2: "allow"}


def test_many_rules_are_joined_like_few(spark, monkeypatch):
    rules = [("block", f"h{i}.org/p{i % 7}") for i in range(100)] + [*url_filter.RULES, ("allow", "h3.org/p3")]
    rows = [(i, f"http://s{i % 5}.h{i % 100}.org/p{i % 7}/{i}") for i in range(500)] + [r[:2] for r in PAGES]
    urls = spark.createDataFrame(rows, "page_id long, url string").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    joined = sorted(map(str, url_filter.with_rule(urls, rules).select("page_id", "host", "path", "rule", "rule_verdict").collect()))
    monkeypatch.setattr(url_filter, "INLINE_RULES", 1000)
    assert sorted(map(str, url_filter.with_rule(urls, rules).select("page_id", "host", "path", "rule", "rule_verdict").collect())) == joined
    assert any("h3.org/p3" in x and "allow" in x for x in joined)


def test_the_plan_of_url_verdicts_runs_no_python(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for df in (url_filter.judge(pages), url_filter.page_edges(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TEXTS = [(None, "a  b\tc \n"), (7, None), (7, ""), (7, "x▁y"), (7, "<s>q</s> <|endoftext|> <0x41>"), (8, "é́ﬁ ① 𝟘 "), (8, " "), (9, "ab cd " * 5000), (9, "  " * 3000 + "x"), (9, "日本語のテキスト" * 50), (10, "plain words, plain words"), (10, "plain words, plain words")]


def tokens_by_the_libraries(text):
    """Ids and bytes of both tokenizers, or nothing where they don't give the text back."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from siltstone.llm.tokens import _LETTERS

    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    back = {v: k for k, v in _LETTERS.items()}
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = [bytes(back.get(c, ord(c)) for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    return [*zip(ids[0], raw[0], strict=True)], [*zip(ids[1], raw[1], strict=True)] if all(b"".join(x) == (" " + text).encode() for x in raw) else None


def plain_alignment(text, links):
    """Groups and linked places by walking over the bytes."""
    both = tokens_by_the_libraries(text)
    if both is None or both[1] is None:
        return [], [], [], []
    spans = []
    for side in both:
        at, own = 0, []
        for _, raw in side:
            own.append((at, at + len(raw)))
            at += len(raw)
        spans.append(own)
    a, b = spans
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups, start = [], 0
    for cut in cuts:
        groups.append([[i for i, (_, e) in enumerate(s) if start < e <= cut] for s in (a, b)])
        start = cut
    if links == "ends":
        pairs = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] == y[1]] if len(a) < 3000 else None
    elif links == "overlaps":
        pairs = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else None
    else:
        pairs = [(i, j) for g, h in groups for i in g for j in h]
    return [i for i, _ in both[0]], [i for i, _ in both[1]], groups, pairs


@pytest.mark.parametrize("links", ["ends", "overlaps", "products"])
def test_alignment_is_what_a_walk_over_the_bytes_gives(spark, links):
    texts = [t for _, t in TEXTS if t is None or len(t) < 1000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, a int")
    got = {r.doc_id: r for r in alignment.align(docs, links).collect()}
    for i, text in enumerate(texts):
        a, b, groups, pairs = plain_alignment(text, links)
        r = got[i]
        assert (r.a, r.b) == (a, b)
        assert [*zip(r.a_in_group, r.b_in_group, strict=True)] == [(len(g), len(h)) for g, h in groups]
        assert sorted(zip(r.link_a, r.link_b, strict=True)) == sorted(pairs)


@pytest.mark.parametrize("head_pairs", [1 << 17, 5])
def test_digest_of_alignment_by_brute_force(spark, monkeypatch, head_pairs):
    monkeypatch.setattr(alignment, "HEAD", head_pairs)
    rng = random.Random(4)
    words = ["the", "tent", "über", "x1", "naïve", "a-b", "日本", "\n"]
    texts = TEXTS[:7] + TEXTS[9:] + [(20 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(30)]
    counts, rows = Counter(), []
    for doc, text in texts:
        a, b, groups, _ = plain_alignment(text, "products")
        linked = [(a[g[-1]], b[h[-1]]) for g, h in groups]
        counts.update(linked)
        spelled = ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups)
        rows.append((doc, len(a), len(b), len(groups), linked, hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    want = sorted(str((d, na, nb, ng, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), s)) for d, na, nb, ng, x, s in rows)
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pairs", F.lit("mine"))
    got = alignment.digest(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert alignment.digest(docs.limit(0)).collect() == []


def test_parts_of_long_texts_give_the_ids_of_the_whole(spark):
    long = [t for _, t in TEXTS if t and len(t) > 1000]
    docs = spark.createDataFrame(enumerate(long), "doc_id long, text string")
    for r in alignment.align(docs).collect():
        a, b = tokens_by_the_libraries(long[r.doc_id])
        assert r.a == [i for i, _ in a] and r.b == [i for i, _ in b]


DOCS = [(None, "x", None, None, None), (1, None, "en", 3, "ABC"), (1, None, "en", 3, "ABC"), (2, "", "en", 3, ""), (3, "é", "en", 3, "É"), (4, "z", "en", 1, None)] + [(i % 50, "big", "en", 1, f"T{i}") for i in range(300)]


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_with_nulls_ties_and_repeats(spark, tmp_path, same, depth):
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("mine")).withColumn("root", F.lit(1))
    got = merkle.manifest(docs, depth=depth)
    same(got, fixture(tmp_path, docs, "documents"), merkle.ORACLE)
    assert merkle.manifest(docs.limit(0), depth=depth).collect() == []


def test_manifest_of_one_document_is_its_leaf(spark):
    docs = spark.createDataFrame([(7, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.manifest(docs).first()
    leaf = hashlib.sha256(b"1:71:s2:en1:11:x").hexdigest()
    assert (r.leaf, r.subroot, r.root, r.folded_root) == (leaf,) * 4 and r.proof_sha256 == hashlib.sha256(b"").hexdigest() and r.verified


def test_levels_and_folding_agree_for_any_number_of_leaves():
    for n in [1, 2, 15, 16, 17, 255, 256, 257, 300]:
        leaves = [hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(n)]
        steps = merkle.levels(b"".join(leaves), n, 9)
        assert len(steps[-1]) == merkle.HEX
        for i in {0, n // 2, n - 1}:
            path = b"".join(x for k, level in enumerate(steps[:-1]) for x in merkle.siblings(level, i // merkle.FANOUT**k))
            assert merkle.fold(leaves[i], path, i, n) == steps[-1]
            assert n == 1 or merkle.fold(leaves[i - 1] if n > 1 else b"", path, i, n) != steps[-1]


def test_tiles_list_a_pair_whose_short_coordinates_agree_by_chance(spark):
    """Two nodes of one bucket, band 5, whose 16-bit coordinates agree in band 0 as well, where their keys differ."""
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 16, (2, minhash.BANDS * minhash.ROWS))
    bands = rng.integers(0, 1 << 62, (2, minhash.BANDS))
    for j in range(minhash.ROWS):
        sig[1, j * minhash.BANDS] = sig[0, j * minhash.BANDS]
        sig[1, j * minhash.BANDS + 5] = sig[0, j * minhash.BANDS + 5]
        sig[1, j], sig[1, j + 5 * minhash.ROWS] = sig[0, j], sig[0, j + 5 * minhash.ROWS]
    bands[1, 5] = bands[0, 5]
    rows = [(int(bands[0, 5]), 5, 2, k, k, bytearray(sig[k].astype("<u2").tobytes()), bands[k].tolist()) for k in (0, 1)]
    members = spark.createDataFrame(rows, "key long, band int, n long, node long, label long, sig binary, bands array<long>")
    listed = {r.node: r.partners for r in minhash._plausible_in_tiles(members, 0.0).collect()}
    assert sorted(p for x in listed.values() for p in x) in ([0], [1]) and set(listed) == {0, 1}
