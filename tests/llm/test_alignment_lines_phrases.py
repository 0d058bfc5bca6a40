"""Token alignment, line dedup and phrases, against brute force and on odd tables."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallyloom.llm import alignment, collocations, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, row long, h long, at long, words long, f long, lost string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, 4, 5, "x") for i, t, lang in rows], SCHEMA)


def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


ODD_TEXT = ["", None, " ", "\n\n", "plain words here", "plain words here", "<|endoftext|> and </s> stay text", "naïve café 日本語 😀 text", "two  spaces \n and\ttabs", "a\x00b", "▁ is no space",
            "x   y é é", "don't 123 4", "<0x41> A", "a" * 5000, "ab " * 3000, "\u0085 x", " lead", "trail "]


def made_up(n):
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", " \n", "é", "日", " the", " ", "'s", " 12", ".", "</s>", "<0x41>", "\t", "\x85", "😀", " word"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def brute_alignment(texts):
    a, b = libraries()
    v = alignment.vocabularies(*alignment.default_files())
    seen = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if not text or any(b"".join(t[i] for i in ids) != whole for t, ids in ((v.tokens_a, ids_a), (v.tokens_b, ids_b))):
            ids_a, ids_b = [], []
        spans = []
        for t, ids in ((v.tokens_a, ids_a), (v.tokens_b, ids_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(t[i]), i))
                at += len(t[i])
            spans.append(own)
        links = Counter((x, y) for p, q, x in spans[0] for r, s, y in spans[1] if p < s and r < q)
        both = sorted({q for _, q, _ in spans[0]} & {q for _, q, _ in spans[1]})
        parts, p = [], 0
        for q in both:
            parts.append("|".join(",".join(str(i) for s, e, i in own if p <= s and e <= q) for own in spans))
            p = q
        seen.append((len(ids_a), len(ids_b), len(both), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if both else ""))
    df = Counter(pair for *_, links, _ in seen for pair in links)
    best = defaultdict(int)
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    return [(n_a, n_b, n_g, sum(links.values()), sum(n for p, n in links.items() if df[p] == best[p[0]]), sum(n * df[p] for p, n in links.items()), sha) for n_a, n_b, n_g, links, sha in seen]


@pytest.mark.parametrize("broadcast_pairs", [2_000_000, 0])
def test_alignment_equals_brute_force(spark, broadcast_pairs):
    texts = [t for t in ODD_TEXT if t is None or len(t) < 1000] + made_up(150)
    docs = table(spark, [(i // 2 if i != 7 else None, t, None) for i, t in enumerate(texts)])  # two rows an id
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = alignment.alignment(docs, broadcast_pairs=broadcast_pairs).collect()
    expected = brute_alignment(texts)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=key) == sorted(((i // 2 if i != 7 else None, *e) for i, e in enumerate(expected)), key=key)


def test_alignment_ids_are_the_libraries(spark):
    a, b = libraries()
    v = alignment.vocabularies(*alignment.default_files())
    rows = duckdb.connect().execute("select coalesce(text, '') from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    for text in [r[0] for r in rows] + [t or "" for t in ODD_TEXT] + made_up(500):
        ids_a, ids_b, *_ = alignment.encoded([text.encode()], v)
        whole = (" " + text).encode()
        own = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        if not text or any(b"".join(t[i] for i in ids) != whole for t, ids in zip((v.tokens_a, v.tokens_b), own)):
            own = ([], [])
        assert (ids_a.tolist(), ids_b.tolist()) == own, text[:80]


def test_alignment_windows_and_groups(monkeypatch):
    v = alignment.vocabularies(*alignment.default_files())
    texts = [t.encode() for t in made_up(60)] + [b"word " * 400]
    whole = alignment.align(texts, v)
    monkeypatch.setattr(alignment, "WINDOW", 64)
    small = alignment.align(texts, v)
    assert whole["groups"] == small["groups"] and all(np.array_equal(whole[k], small[k]) for k in ("n_a", "n_b", "n_groups", "n_links", "pairs", "times"))
    assert [len(alignment.groups(t.decode())) for t in texts] == whole["n_groups"].tolist()


def brute_lines(rows, least_chars=20, least_docs=3):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least_docs or i is not None and i >= max(h for h in holders[key(x)] if h is not None)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = random.Random(9)
    pool = [f"a line that many documents hold, number {i}" for i in range(40)] + ["short", "", "É" * 20, "É" * 19, "  A LINE that many documents hold, number 3\t", "x" * 70_000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) if i % 7 else None) for i in range(120)]
    rows += [(5, rows[5][1]), (5, "another text of one id\n" + pool[3]), (None, pool[3] + "\n" + pool[4]), (None, pool[3]), (200, ""), (201, "\n\n"), (202, "alone in the whole corpus, this line\n" * 3)]
    return rows


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_line_dedup_equals_brute_force(spark, broadcast_bytes):
    rows = line_rows()
    got = line_dedup.line_dedup(table(spark, [(i, t, None) for i, t in rows]), broadcast_bytes=broadcast_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_lines(rows), key=key)


def test_layout_of_filters():
    """Shards of a bounded size, bits in proportion to the lines that a corpus could hold."""
    layout = line_dedup.Layout(2000)
    assert layout.shards >= 1 and layout.bits & (layout.bits - 1) == 0
    big = line_dedup.Layout(10**12)
    assert big.bits == 1 << 27 and big.shards * big.bits >= 10**13
    hashes = np.arange(1, 5000, dtype=np.uint64)
    places = layout.places(hashes)
    assert places.min() >= 0 and places.max() < layout.bits and places.shape == (4999, line_dedup.PROBES)


@pytest.mark.parametrize("top, pairs", [(2000, 8_000_000), (3, 0)])
def test_collocations_equal_sql(spark, top, pairs, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_PAIRS", pairs)
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "delta", "é", "x", "y"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n"]) for _ in range(60)) if i % 11 else None, rng.choice(["en", "de", None, "und", "a\tb\n%"])) for i in range(150)]
    rows += [(7, "new york city hall is a new york city hall", "en")] * 40 + [(8, "New York city", "en")] * 35 + [(900, "", "fr"), (901, "once only", "zz")]
    docs = table(spark, rows)
    monkeypatch.setattr(collocations, "STEP_WORDS", 50)
    got = collocations.collocations(docs, top=top).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas())
    expected = con.execute(collocations.ORACLE.replace("<= 2000", f"<= {top}")).df()
    order = ["lang", "rank"]
    assert len(expected) and got.sort_values(order).values.tolist() == expected.sort_values(order)[list(got.columns)].values.tolist()


def test_collocations_are_exact_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_001
    row = spark.createDataFrame([(a, l, r)], "a long, l1 long, r1 long").selectExpr("(cast(a as decimal(20,0)) * 2000000) div (cast(l1 as decimal(20,0)) + cast(r1 as decimal(20,0))) as s").first()
    assert row.s == 2_000_000 * a // (l + r)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert not alignment.alignment(empty).collect() and not line_dedup.line_dedup(empty).collect() and not collocations.collocations(empty).collect()


def test_one_very_long_text(spark):
    docs = table(spark, [(1, "word " * 400_000, "en"), (2, "z" * 1_000_000, None)])
    got = {r.doc_id: r for r in alignment.alignment(docs).collect()}
    assert got[1].n_groups and got[2].n_links == got[2].n_a + got[2].n_b - got[2].n_groups
    assert collocations.collocations(docs).where("phrase = 'word word word word'").first().a == 399_997
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs).collect()} == {1: 0, 2: 0}
