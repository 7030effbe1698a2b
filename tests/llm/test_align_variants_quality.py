"""Token alignment, spelling variants and quality rules against plain Python, with their edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import quality, queries, token_align, variants
from cadenza.llm.tokens import byte_symbols

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns named like those that the operators make.
CLASH = "doc_id long, text string, n_a long, key string, score string, kept long, word string, n long, t string"
ODD = [None, "", " ", "  two", "a▁b", "<|endoftext|> </s> <s>", "née ಠಠ 😀 \x00\t\r\n x", "a" * 3000, "word " * 400, "no cut" + "中文" * 700, "same text twice", "same text twice", "<0x41> <unk>"]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 5, "k", "s", 9, "w", 3, "t") for i, t in rows], CLASH)


def documents():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


# token alignment


def brute_alignment(rows):
    a_lib, b_lib, sym = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_symbols()
    a_lib.encode_special_tokens = True
    name = {i: t for t, i in a_lib.get_vocab().items()}
    bytes_a = lambda i: bytes(sym[c] for c in name[i])
    bytes_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], Counter()
    for doc_id, text in rows:
        whole = (" " + text).encode() if text else b""
        a = [(i, bytes_a(i)) for i in a_lib.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes_b(i)) for i in b_lib.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((doc_id, [], [], [], Counter()))
            continue
        owner_a, owner_b = ([k for k, (_, x) in enumerate(t) for _ in x] for t in (a, b))
        pairs = sorted(set(zip(owner_a, owner_b)))
        groups, ga, gb = [], [], []
        for k in range(len(whole)):
            last_a, last_b = (k + 1 == len(whole) or o[k] != o[k + 1] for o in (owner_a, owner_b))
            ga += [a[owner_a[k]][0]] if last_a else []
            gb += [b[owner_b[k]][0]] if last_b else []
            if last_a and last_b:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter((a[x][0], b[y][0]) for x, y in pairs)
        held.update(links.keys())
        found.append((doc_id, a, b, groups, links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for doc_id, a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        yield (doc_id, len(a), len(b), len(groups), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if said else "")


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_alignment_query_equals_plain_python(spark):
    got = queries.op11_token_alignment(spark, SF)
    assert got.columns == NAMES
    assert in_order(got.collect()) == in_order(brute_alignment(documents()))


@pytest.mark.parametrize("sizes", [{}, {"long_bytes": 300, "part_bytes": 200, "chunk_bytes": 37}, {"long_bytes": 50, "part_bytes": 1, "chunk_bytes": 5, "head_pairs": 40}])
def test_alignment_of_odd_rows_in_chunks_of_any_size(spark, sizes):
    rows = [*enumerate(ODD), (None, "a null id"), (3, "an id of two rows")]
    got = token_align.align_tokens(clashing(spark, rows), BPE, PIECES, **sizes).collect()
    assert in_order(got) == in_order(brute_alignment(rows))


def test_alignment_of_nothing(spark):
    assert token_align.align_tokens(clashing(spark, [(1, "x")]).limit(0), BPE, PIECES).count() == 0
    assert token_align.align_tokens(clashing(spark, [(1, "x")]).limit(0), BPE, PIECES, long_bytes=0).count() == 0
    assert [tuple(r)[1:] for r in token_align.align_tokens(clashing(spark, [(1, None), (2, "▁")]), BPE, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_fragments_compose_alike_in_any_order():
    enc = token_align.Encoders(token_align.read_tokenizer(BPE), open(PIECES, "rb").read())
    text = "Unaccountably, the zyzzyva's née-ing of 漢字漢字漢字 went on for 1234567 days. " * 4
    (a,), (b,), _ = enc.encode([text])
    ends_a, ends_b = (x.size[ids].cumsum() for x, ids in ((enc.bytes_a, a), (enc.bytes_b, b)))
    whole = token_align.Aligned(a, ends_a, b, ends_b).rendered()[0].tobytes()
    sizes = enc.bytes_a.size, enc.bytes_b.size
    rnd = random.Random(3)
    for chunk_bytes in (1, 2, 7, 40):
        rows = list(token_align.chunk_rows(9, 0, a, ends_a, b, ends_b, chunk_bytes))
        opened, closed = [r for r in rows if "cut" in r], [r for r in rows if "cut" not in r]
        assert chunk_bytes > 2 or any(not r["cut"] for r in opened)
        while len(opened) > 1:  # any two neighbours
            i = rnd.randrange(len(opened) - 1)
            one, *more = token_align.compose(opened[i : i + 2], *sizes, False)
            opened[i : i + 2] = [one]
            closed += more
        closed += token_align.compose(opened, *sizes, True)
        assert b"".join(r["body"] for r in sorted(closed, key=lambda r: r["pos"])) == whole


# spelling variants


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    near, form = {}, {}
    for w in n:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        found = {x + y[1:] for x, y in cuts} | {x + c + y[1:] for x, y in cuts if y for c in letters} | {x + c + y for x, y in cuts for c in letters}
        near[w] = (found & n.keys()) - {w}
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield (w, form[w], root, n[w], len(near[w]), n.get(form[w]))


def test_variants_query_equals_plain_python(spark):
    got = queries.op12_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert in_order(got.collect()) == in_order(brute_variants(documents()))


def test_variants_of_odd_rows(spark):
    rnd = random.Random(5)
    stems = ["aaaaa", "aaaaaa", "baaaaa", "hello", "helo", "helllo", "àéîõü", "àéîõ", "abcdefgh" * 40]
    words = [w[:i] + rnd.choice("abhàé") + w[i + rnd.randint(0, 1) :] for w in stems for i in [rnd.randint(0, len(w) - 1) for _ in range(20)]] + stems * 6
    rows = [(rnd.randint(0, 9), " ".join(rnd.choice(words).upper() if rnd.random() < 0.1 else rnd.choice(words) for _ in range(40))) for _ in range(60)]
    rows += [(None, "hello hello"), (None, None), (1, ""), (2, "x" * 200_000), rows[0], rows[0]]
    want = in_order(brute_variants(rows))
    assert len({r[2] for r in want}) < len(want) and max(r[4] for r in want) > 4
    d = clashing(spark, rows)
    assert in_order(variants.spelling_variants(d).collect()) == want
    assert in_order(variants.spelling_variants(d.repartition(7)).collect()) == want
    assert variants.spelling_variants(d.limit(0)).count() == 0
    assert variants.spelling_variants(clashing(spark, [(1, "once upon a time")])).count() == 0


def test_trie_numbers_are_the_same_for_equal_prefixes_of_all_blocks(spark):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(800)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = variants.numbered(spark.createDataFrame([(w,) for w in words], "word string"), F.col("word"), "node").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = {}
    for r in got:
        for i, node in enumerate(r["node"]):
            assert number.setdefault(r["word"][: i + 1], node) == node
    assert len(set(number.values())) == len(number)
    ends = [number[w] for w in words]
    assert ends == sorted(ends)


# quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, lines = Counter(windows), [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def brute_quality(rows, labels, lose=0.002):
    """Every n-gram in a dictionary of its own bucket; only the hash of a word is the operator's."""
    marks = re.compile(r"[!-/:-@\[-`{-~]|[^\x20\x09-\x0d!-/:-@\[-`{-~]+")
    good = {}
    for i, q in labels:
        good[i] = good.get(i, 1) and q == 1
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0

    def grams(text):
        words = marks.findall(text or "")
        if not words:
            return []
        block = quality.Block([" ".join(words)])
        return [int(x) for bucket, _ in quality.ngram_buckets(block) for x in bucket]

    each = [(i, t, grams(t)) for i, t in rows]
    raw, target = Counter(), Counter()
    for i, _, g in each:
        raw.update(g)
        if good.get(i) and not held(i):
            target.update(g)
    nr, nt = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = lambda x: math.log((target[x] + 1) / nt) - math.log((raw[x] + 1) / nr) if target else 0.0
    score = [sum(map(ratio, g)) / len(g) if g else 0.0 for _, _, g in each]
    trusted = sorted(s for (i, _, _), s in zip(each, score) if good.get(i) and held(i))
    at = math.floor(trusted[int(lose * len(trusted))] / quality.STEP) * quality.STEP if trusted else quality.LEAST
    for (i, t, _), s in zip(each, score):
        c = brute_counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        yield (i, *c, failed, round(s, 9), not failed and s >= at)


def quality_rows(df):
    return in_order((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"], round(r["score"], 9), r["kept"]) for r in df.collect())


def test_quality_query_equals_plain_python(spark):
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()]
    got = queries.op13_quality(spark, SF)
    assert quality_rows(got) == in_order(brute_quality(documents(), labels))


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    found = queries.op13_quality(spark, sf).join(labels, "doc_id")
    kept = {r["quality"]: r["kept"] for r in found.where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.35


def test_quality_of_odd_rows(spark):
    five = "one two three four five"
    rows = [*enumerate(ODD), (None, "a null id is never trusted but scored all the same as others are"), (3, f"{five} x {five} y {five}"), (3, "a b\n\na b\n \nA b\na b"), (50, f"{five} {five} {five}"), (51, " ".join(f"w{i}" for i in range(40)) + " #*$%&|<>")]
    labels = [(i, 1) for i in (2, 3, 5, 6, 8, 9, 10, 51)] + [(9, 0), (None, 1), (3, 1), (77, 1)]
    table = spark.createDataFrame([(i, q, 0, "x") for i, q in labels], "doc_id long, quality int, toxic int, score string")
    d = clashing(spark, rows)
    got = quality.quality_rules(d, table)
    assert got.columns == ["doc_id", *quality.COUNTS, "base_failed", "score", "threshold", "kept"]
    assert quality_rows(got) == in_order(brute_quality(rows, [x for x in labels if x[0] is not None]))
    assert quality_rows(quality.quality_rules(d.repartition(5), table)) == quality_rows(got)
    assert quality_rows(quality.quality_rules(d, table.limit(0))) == in_order(brute_quality(rows, []))
    assert quality.quality_rules(d.limit(0), table).count() == 0
