"""Edge rows of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import chat, html_extract, kdtree, line_dedup, media, near_dedup, packing, piece_lattice, token_count, toxicity
from cadenza.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, kept boolean"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "a line of more than forty characters that many documents share"
TEXTS = [None, "", "one", f"{LONG}\nmine", f"x\n{LONG.upper()}  \n{LONG}", f"{LONG}", f"\t{LONG}\r", f"{LONG}\nend\n", "é 😀 <|endoftext|> ~0   x", "word " * 30_000, "dup text of five words here", "dup text of five words here"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "x", None) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark)).collect()}
    assert got[7]["kept_text"] == f"{LONG}\nend\n" and got[7]["n_dropped"] == 0 and got[7]["n_lines"] == 3
    assert got[4]["kept_text"] == "x" and got[4]["n_dropped"] == 2
    assert got[3]["kept_text"] == "mine" and got[5]["kept_text"] == ""
    assert (got[0]["n_lines"], got[0]["kept_text"], got[1]["n_lines"]) == (1, "", 1)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute_force_lines(rows):
    """(id, text, kept, n_lines, n_dropped) of every row; documents are rows."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held, keeper = defaultdict(int), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            keeper[k] = max((x for x in (keeper.get(k), i) if x is not None), default=None)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and held[key(x)] >= 5 and (i is None or keeper[key(x)] != i))]
        out.append((str(i), t or "", "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_line_dedup_equals_brute_force(spark, most_bytes):
    rnd = random.Random(1)
    lines = [f"{i} {'y' * 45}" for i in range(300)] + ["short", "", f"  {LONG.upper()}\r"]
    rows = [(rnd.choice([None, *range(60)]), "\n".join(rnd.choices(lines, k=rnd.randint(1, 20)))) for _ in range(200)]
    rows += [*enumerate(TEXTS), (7, LONG), (7, LONG), (8, LONG), (8, LONG)]
    d = spark.createDataFrame([(i, t, None, None, None, 0.5, "x", None) for i, t in rows], DOCS).withColumn("n_lines", F.lit("x"))
    got = line_dedup.dedup_lines(d, shard_keys=20, most_bytes=most_bytes).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got) == brute_force_lines(rows)
    assert line_dedup.dedup_lines(empty(spark), most_bytes=-1).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 5000):
        h1, h2 = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, n)
        h1[: n // 2] = h1[:1]  # equal first hashes are told apart by the second
        assert sorted(line_dedup.PerfectHash(h1, h2).index(h1, h2)) == list(range(n))


def naive_components(sets, percent):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in sets}


def word_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("free", [20_000_000, 40])
def test_near_duplicates_equal_brute_force(spark, free):
    rnd = random.Random(2)
    base = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(60)] for _ in range(4)]
    texts = [*TEXTS, " ONE ", "ONE"]
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"z{rnd.randint(0, 9)}"
        texts.append(" ".join(w))
    got = {r["id"]: r for r in near_dedup.near_duplicates(docs(spark, texts), percent=85, most_pairs=0, free_pairs=free).collect()}
    sets = {i: word_set(t) for i, t in enumerate(texts)}
    want = naive_components(sets, 85)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_with_shared_ids(spark):
    rnd = random.Random(3)
    said = lambda: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 999)) for _ in range(60))
    rows, want = [], {}
    for i in range(0, 80, 2):  # (i, X), (i + 1, X'), (i + 1, Y), in both orders of the last two, and a near copy of Y
        x, y = said(), said()
        pair = [(i + 1, f"{x} end"), (i + 1, y)]
        rows += [(i, x), *(pair if i % 4 else pair[::-1]), (i + 100, f"{y} end")]
        want |= {(i, x): (i, True), (i + 1, f"{x} end"): (i, False), (i + 1, y): (i + 1, True), (i + 100, f"{y} end"): (i + 1, False)}
    df = spark.createDataFrame([(i, t, None, None, None, 0.5, "x", None) for i, t in rows], DOCS)
    hashed = df.select("doc_id", "text", near_dedup.text_hash(F.col("text")).alias("text_hash"))
    out = near_dedup.near_duplicates(df, with_hash=True).withColumnRenamed("id", "doc_id").join(hashed, ["doc_id", "text_hash"])
    assert {(r["doc_id"], r["text"]): (r["component_id"], r["kept"]) for r in out.collect()} == want
    left = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted(x for x, (_, kept) in want.items() if kept)


def test_signature_estimate(spark):
    a, b = near_dedup.multipliers(near_dedup.MINIMA)
    x = near_dedup.mix64(np.arange(1, 4001, dtype=np.uint64))
    m, n = near_dedup.minima(x[:3000], a, b) & 15, near_dedup.minima(x[500:3500], a, b) & 15
    assert abs(((m == n).mean() - 1 / 16) / (15 / 16) - 2500 / 3500) < 0.1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_toxicity_learns_words_and_families(spark):
    rnd = random.Random(3)
    clean = [" ".join(rnd.choice("the of and to in is that for".split()) + rnd.choice("abcdef") for _ in range(40)) for _ in range(600)]
    bad = ["zzrude", "qqfoul"]
    rows = [(f"{t} {rnd.choice(bad)}{rnd.choice(['', 'er', 'ing'])} {t[:20]}", 1) if i % 4 == 0 else (t, 0) for i, t in enumerate(clean)]
    model = toxicity.fit(rows[:400])
    d = docs(spark, [t for t, _ in rows[400:]] + [None, "", "zzrudest"])
    got = toxicity.score_toxicity(d, model).orderBy("doc_id").collect()
    assert sum(r["predicted"] == y for r, (_, y) in zip(got, rows[400:])) >= 198
    assert all(0 <= r["score"] <= 1 for r in got) and got[-2]["predicted"] == 0
    r = next(r for r, (_, y) in zip(got, rows[400:]) if y)
    assert any(r["text"][s["start"] : s["end"]].startswith(("zz", "qq")) for s in r["spans"])
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    assert toxicity.score_toxicity(d, toxicity.fit([])).where("predicted = 1").count() == 0


def test_toxic_spans_after_a_letter_with_a_longer_lower_case(spark):
    model = toxicity.ToxicityModel({"=zz": 20.0}, bias=-8.0)
    d = spark.createDataFrame([(1, "İİ a zz b c d", "x", 2.0), (1, "İİ a zz b c d", None, None)], "doc_id long, text string, spans string, score double")
    rows = toxicity.score_toxicity(d, model).collect()
    assert [[r["text"][s["start"] : s["end"]] for s in r["spans"]] for r in rows] == [["zz"], ["zz"]]
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(d, labels).weights == {}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    trans = np.array([[0.0, -1.0], [0.3, 0.7]])
    lengths = np.array([1, 5, 3])
    e = rng.normal(size=9)
    got, at = toxicity.marginals(e, lengths, trans), 0
    for n in lengths:
        z = np.zeros((n, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = math.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            for i in range(n):
                z[i, y[i]] += p
        assert np.allclose(got[at : at + n], np.log(z[:, 1] / z[:, 0]))
        at += n


def test_token_counts(spark):
    t = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r for r in token_count.count_tokens(docs(spark), BPE).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(t.encode(x or "", add_special_tokens=False).ids) and got[i]["n_bytes"] == len((x or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 512)
    assert token_count.count_tokens(empty(spark), BPE).count() == 0
    c = token_count.TokenCounter(open(BPE).read())
    rnd = random.Random(5)
    for _ in range(500):
        s = "".join(rnd.choice([*"ab '_sS\n\t\x1c\x85é²中😀٣", "<|endoftext|>", "'re", "  "]) for _ in range(rnd.randint(0, 30)))
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids)


def test_packing(spark):
    t = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(docs(spark), BPE).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack_documents(empty(spark), BPE).count() == 0


def test_plan_covers_demand():
    rng = np.random.default_rng(6)
    for size in (4, 16, 64):
        demand = rng.integers(0, 50, size)
        plan = packing.plan(demand)
        assert (sum(a * n for a, n in plan) == demand).all()
        assert all((a * np.arange(1, size + 1)).sum() <= size for a, _ in plan)
        assert sum(n for _, n in plan) <= math.ceil((demand * np.arange(1, size + 1)).sum() / size) + size
    assert packing.plan(np.zeros(8, int)) == []


PAGES = {
    "": "",
    "<nav>a<li>b</nav><article><h1>T &amp; U</h1><p>x <b>y</b>&nbsp; z<p>w</article><footer>f</footer>": "T & U\nx y z\nw",
    "<script>var a='</p>';</script><article>k<br>l<br><br>m<!-- <p>no</p> --></article>": "k l\nm",
    '<div class="ad">buy</div><p>Real': "Real",
    '<article><p>text</p><div id="comments"><p>me too</p></div><form><p>mail</p></form></article>': "text",
    "<p>One <i>two": "One two",
}


def test_html(spark):
    df = spark.createDataFrame([(i, h, "old", None) for i, h in enumerate([*PAGES, None])], "page_id long, html string, text string, n_blocks string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    for i, want in enumerate([*PAGES.values(), ""]):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert html_extract.extract(df.limit(0)).count() == 0
    prose = "The cat sat on the mat and it was the best of all that he had for his own in the house of the man. " * 3
    menu = "".join(f'<li><a href="#">item {i}</a></li>' for i in range(9))
    assert html_extract.main_text(f"<ul>{menu}</ul><div><h2>Head</h2><p>{prose}</p><p>Short.</p><p>{prose}</p></div>")[0].split("\n")[0] == "Head"


def test_html_wrappers_keep_the_main_text():
    text = html_extract.main_text
    prose = ("The cat sat on the mat and it was the best of all that he had for his own in the house of the man. " * 3).strip()
    polish = ("Wczoraj wieczorem spotkałem starego przyjaciela, który opowiedział mi historię swojej rodziny i długiej podróży przez góry. " * 3).strip()
    for around in ('<div class="layout has-sidebar">', '<form id="aspnetForm"><div>', '<div class="sidebar">', '<div id="menu"><form>'):
        assert text(f"{around}<article><header><h1>Head</h1></header><p>{prose}</p></article>")[0] == f"Head\n{prose}"
    assert text(f'<article class="post comments-open"><p>{prose}</p></article>')[0] == prose
    assert text(f'<form id="aspnetForm"><div><p>{prose}</p></div></form>')[0] == prose
    assert text(f'<div><a href="/">Start</a></div><div><p>{polish}</p><p>{polish}</p></div>')[0] == f"{polish}\n{polish}"
    # teasers, comments and forms beside a main text stay out
    assert text(f'<article><p>{prose} {prose}</p></article><div class="related"><article><p>{prose}</p></article></div>')[0] == f"{prose} {prose}"
    assert text(f'<div><p>{prose}</p></div><div id="comments"><article class="comment"><p>{prose} {prose}</p></article></div>')[0] == prose
    assert text(f"<div><p>{prose}</p></div><form><p>Your name</p><p>{prose[:99]}</p></form>")[0] == prose


def test_html_hostile_markup_is_linear():
    html_extract.main_text("<" * 20_000 + "<a b='" * 2_000 + "<!--" * 2_000)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    alphabet = ["~", "~1", "<|turn|>", "<|end|>\n", "[INST]", "</s>", "\n", "é", "x y z ", "<<SYS>>", ""]
    rnd = random.Random(7)
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows += [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, 0, 1, 2, 2000]), rnd.choice([None, "system", "user", "assistant", "a\nb~"]), rnd.choice([None, "".join(rnd.choices(alphabet, k=9))])) for _ in range(90)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    want = defaultdict(list)
    for c, n, r, t in rows:
        want[c].append((-1 if n is None else n, r or "", t or ""))
    for budget, history in ((512, 128), (40, 15), (8, 3)):
        w = chat.format_windows(df, budget=budget, history=history)
        got = {r["conv_id"]: r for r in chat.conversation_digests(w).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            turns.sort()
            target = "".join(t for _, r, t in turns if r == "assistant")
            assert got[c]["n_turns"] == len(turns)
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
            assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_windows(df.limit(0))).count() == 0


def test_chat_windows_repeat_and_keep_the_budget(spark):
    rnd = random.Random(12)
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "w " * rnd.randint(0, 60)) for i in range(1, 40)]
    rows += [(2, 0, "user", "long " * 900), (2, 1, "assistant", "ok"), (2, 2, "system", "late"), (3, 0, "system", "rules " * 150)]
    rows += [(3, i, "assistant", f"a{i} " * 9) for i in range(1, 12)] + [(4, i, "user", "x") for i in range(2500)]
    for budget, history in ((200, 40), (60, 20)):
        w = chat.format_windows(spark.createDataFrame(rows, schema), budget=budget, history=history).orderBy("conv_id", "window").collect()
        for c in (1, 2, 3, 4):
            mine = [x for x in w if x["conv_id"] == c]
            assert [x["window"] for x in mine] == list(range(len(mine))) and mine[0]["n_repeated"] == 0
            before: list[str] = []
            for x in mine:
                turns = x["formatted"].split("<|turn|>")[1:]
                own = turns[x["n_repeated"] :]
                assert own and (count(x["formatted"]) <= budget or len(own) == 1)
                again = turns[: x["n_repeated"]]
                if c in (1, 3) and x["window"]:
                    assert again[0].startswith("system\n")
                    again = again[1:]
                assert again == before[len(before) - len(again) :] and sum(count("<|turn|>" + t) for t in again) <= history
                assert len(x["loss"]) == sum(t.startswith("assistant\n") for t in own)
                before = own
    first = [x for x in w if x["conv_id"] == 4]
    assert sum(len(x["formatted"].split("<|turn|>")) - 1 - x["n_repeated"] for x in first) == 2500


@pytest.mark.parametrize(("shard_rows", "shard_queries"), [(60, 16_384), (25, 2), (None, 16_384)])
def test_top_k_equals_brute_force(spark, shard_rows, shard_queries):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(200)] + [(600, None), (601, [float("nan")] * 6), (602, [None] * 6), (603, [float("inf")] * 6), (604, [1.0, 2.0]), (None, [1.0] * 6), (700, [0.0] * 6)]
    rows += [(100, rows[100][1]), (200, [0.5] * 6), (900, [1.0] * 3), (901, [2.0] * 3), (7, rows[8][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    out = kdtree.top_k(df, F.col("vec_id") % 100 == 0, k=10, shard_rows=shard_rows, shard_queries=shard_queries, sample_rows=200)
    for r in out.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = defaultdict(list)
    for q, x in {(i, tuple(x)) for i, x in fine if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in fine if c != q and len(y) == len(x))[:10]
        want[q] += [(n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert kdtree.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_very_large_components(spark):
    rows = [(i, [2.0**30 * (i + 1), -(2.0**29)]) for i in range(5)] + [(9, [2.0**60, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in kdtree.top_k(df, F.col("vec_id") == 0, k=9, scale=1).orderBy("rank").collect()]
    want = sorted(((i, int(2**30 * v[0]) + 2**58) for i, v in rows[1:5]), key=lambda x: -x[1])
    assert [x for x in got if x[0] != 9] == want


def test_shards_follow_regions():
    v = np.random.default_rng(1).integers(-50, 50, (500, 3))
    nodes, after = kdtree.plan_shards(v, 5000, 1000, 7)
    got = kdtree.route(nodes, np.arange(500), v)
    assert after - 7 >= 5 and set(got) == set(range(7, after)) and np.bincount(got - 7).max() <= 100
    nodes, after = kdtree.plan_shards(np.ones((50, 2), np.int64), 5000, 1000, 0)  # equal rows are dealt by their ids
    assert after == 5 and len(set(kdtree.route(nodes, np.arange(500), np.ones((500, 2), np.int64)))) == 5


def test_media_round_trip(spark):
    d = docs(spark).select("doc_id", "text", "score")
    got = {r["doc_id"]: r for r in media.decode_media(media.encode_media(d)).collect()}
    for i, x in enumerate(TEXTS):
        p = media.padded((x or "").encode())
        r = got[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    assert got[10]["feature"] == got[11]["feature"]
    assert media.decode_media(media.encode_media(empty(spark))).count() == 0


def test_media_general_decoder_agrees(monkeypatch):
    for n in (64, 640, 5056):
        raw = media.encode(random.Random(n).randbytes(n))
        fast = media.decode(raw)
        with monkeypatch.context() as m:
            m.setattr(media, "_read_uniform", lambda *a: False)
            slow = media.decode(raw)
        assert all((a.coef == b.coef).all() for a, b in zip(fast.components, slow.components))
    assert sorted(media.ZIGZAG) == list(range(64)) and list(media.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2]


def piece_ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def brute_force_pieces(lattice, text):
    """Every segmentation of a whole text with its merges, best first."""
    s, out = "▁" + text.replace(" ", "▁"), []
    place = [k for u in lattice.units(text) for k in range(len(u))]  # places count within units

    def go(i, made, ids):
        if i == len(s):
            out.append((made, ids))
        for j in range(i + 1, min(len(s), i + 16) + 1):
            p = lattice.piece.get(s[i:j], -1)
            if p >= 0 or j == i + 1:
                merges = [(r, place[i + at]) for r, at in lattice.merges(p)] if p >= 0 else []
                go(j, made + merges, ids + ([p] if p >= 0 else list(lattice._fallback(s[i]))))

    go(0, [], [])

    def better(x, y):
        for r in sorted({r for r, _ in x[0] + y[0]}):
            a, b = ((sum(q == r for q, _ in z), -sum(at for q, at in z if q == r)) for z in (x[0], y[0]))
            if a != b:
                return -1 if a > b else 1
        return 0

    return sorted(out, key=functools.cmp_to_key(better)), better


def test_pieces_equal_brute_force():
    lattice = piece_lattice.Lattice(open(PIECES, "rb").read(), 4)
    rnd = random.Random(9)
    for _ in range(300):
        s = "".join(rnd.choice("aabthe  in on😀é\n") for _ in range(rnd.randint(1, 9)))
        want, better = brute_force_pieces(lattice, s)
        got = next(lattice.encode([s]))
        assert len(got) == min(4, len(want)) and got[0][0] == 0
        by_ids = {tuple(ids): (made, ids) for made, ids in want}
        for (_, ids), w in zip(got, want):  # ties may come in any order
            assert better(by_ids[tuple(piece_ids(ids))], w) == 0
        assert len({x for _, x in got}) == len(got)
        assert all(lattice.decode(np.array(piece_ids(x))) == s for _, x in got)


def test_best_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lattice = piece_lattice.Lattice(open(PIECES, "rb").read(), 2)
    rnd = random.Random(10)
    parts = ["a", "aa", "th", "e", "in", "on", " ", "  ", "é", "😀", "\n", "\t", "ing", "ss", "ll", "&&", "▁", "中", "Ünd", "0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 20_000, "thequickbrownfox" * 300, "é" * 3000, "", " ", *(t or "" for t in TEXTS)]
    for t, found in zip(texts, lattice.encode(texts)):
        assert piece_ids(found[0][1]) == library.encode(t)


def test_units_of_the_arrays_equal_their_searches():
    lattice = piece_lattice.Lattice(open(PIECES, "rb").read(), 3)
    rnd = random.Random(11)
    units = {"▁" + "".join(rnd.choice(["th", "er", "an", "rr", "r", "e", "s", "ion", "é"]) for _ in range(rnd.randint(1, 9))) for _ in range(2000)}
    lattice.learn(units)
    for u in units:
        found = lattice.segment(u, 2)
        assert lattice.best[u] == (found[0][1], found[1][0].lead() if len(found) > 1 else piece_lattice.NONE)


def test_pieces_table(spark):
    d = docs(spark, [*TEXTS, "a▁b", " "]).withColumn("nbest", F.lit(1))
    out = piece_lattice.encode_nbest(d, PIECES, n=2)
    rows = {r["doc_id"]: r["nbest"] for r in out.collect()}
    last = len(TEXTS)
    assert rows[0][0]["n_pieces"] == 0 and all(x["round_trip"] for i, found in rows.items() if i != last for x in found)
    assert not any(x["round_trip"] for x in rows[last])  # the space mark itself is a space to such files
    assert all(x["n_pieces"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<i4").tobytes()) for found in rows.values() for x in found)
    ids = out.select("doc_id", F.col("nbest")[0]["ids"].alias("ids"))
    back = {r["doc_id"]: r["decoded"] for r in piece_lattice.decode_ids(ids, PIECES).collect()}
    assert back == {i: t or "" for i, t in enumerate([*TEXTS, "a b", " "])}
    odd = spark.createDataFrame([(None,), ([],), ([None, -5, 10**6],)], "ids array<int>")
    assert [r["decoded"] for r in piece_lattice.decode_ids(odd, PIECES).collect()] == [None, "", ""]
    assert piece_lattice.encode_nbest(empty(spark), PIECES).count() == 0
    assert all(x["ids"] is None for r in piece_lattice.encode_nbest(d, PIECES, with_ids=False).collect() for x in r["nbest"])


def test_pipeline_stages_keep_columns(spark, tmp_path):
    rnd = random.Random(10)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(60)) + ("\n" + LONG if i % 3 == 0 else ""), "en", "s", None) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", None), (101, None, None, None, None), (102, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in d.collect()}
    assert kept == set(range(60)) | {101, 102}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_every_segmentation_is_checked_by_what_it_decodes_to():
    lattice = piece_lattice._lattice(piece_lattice._read(public_tokenizers.path("piece_bpe_32k.model")), 4)
    rng = random.Random(5)
    texts = ["", " ", "▁", "a▁b", " x", "née ಠಠ ok", "\x00tab\t\n"] + ["".join(rng.choices("ab ▁é漢\n the", k=rng.randrange(1, 40))) for _ in range(300)]
    for text, found in zip(texts, lattice.checked(texts)):
        assert found and all(says == lattice.says(ids, text) == (lattice.decode(np.frombuffer(ids, "<i4")) == text) for _, ids, says in found), text


@pytest.mark.parametrize("n", [1023, 1024, 1025, 5000])
def test_chat_windows_equal_plain_python_however_many_turns(spark, n):
    rnd = random.Random(n)
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " * rnd.choice([1, 1, 2, 9, 80])) for i in range(1, n)] + [(2, i, "user", "x") for i in range(n)]
    budget, history = 120, 40
    got = defaultdict(list)
    for r in chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget, history=history).orderBy("conv_id", "window").collect():
        got[r["conv_id"]].append((r["formatted"], r["n_repeated"]))
    for c in (1, 2):
        pieces = [f"<|turn|>{role}\n{text}<|end|>\n" for k, _, role, text in rows if k == c]
        top = pieces[:1] if c == 1 else []
        want, own, old = [], [], []
        for i, p in enumerate(pieces):
            room = max(1, budget - history - sum(map(count, top))) if want else budget
            if own and sum(map(count, own)) + count(p) > room:
                want.append((old, own))
                old, left = [], history
                for q in reversed(own):
                    left -= count(q)
                    if left < 0 or q is pieces[0] and top:
                        break
                    old.insert(0, q)
                old, own = [*top, *old], []
            own.append(p)
        want.append((old, own))
        assert got[c] == [("".join([*o, *w]), len(o)) for o, w in want]


def test_top_k_samples_wide_vectors_by_their_bytes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    wide = rng.integers(-50, 50, (400, 768)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(wide)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(kdtree, "SAMPLE_BYTES", 100 * 768 * 8)
    seen = []
    plan = kdtree.plan_shards
    monkeypatch.setattr(kdtree, "plan_shards", lambda sample, *more: seen.append(sample.nbytes) or plan(sample, *more))
    got = kdtree.top_k(df, F.col("vec_id") % 100 == 0, k=5, scale=1, shard_rows=100).collect()
    assert 0 < sum(seen) <= kdtree.SAMPLE_BYTES
    for q in (0, 100, 200, 300):
        order = sorted((-int(wide[q] @ wide[c]), c) for c in range(400) if c != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, c, -s) for n, (s, c) in enumerate(order)]
