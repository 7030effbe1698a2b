"""The registered queries over whole small tables, against plain Python, the libraries and their SQL."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
import zlib
from tokenizers import Tokenizer

from cadenza.llm import queries

SF = "/root/testdata/sf0.001"


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_sql_of_the_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(x) for x in df.select(*names).collect()) == sorted(r.fetchall())


def test_chat_query_equals_plain_python(spark):
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in rows_of("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op8_chat_format(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        t.sort()
        target = "".join(x for _, role, x in t if role == "assistant")
        r = got[c]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in t).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(t), len(target), hashlib.sha256(target.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(x) for _, _, x in t)


def test_token_queries_equal_the_libraries(spark):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] or "" for r in rows_of("documents")}
    counted = queries.op3_token_count(spark, SF).collect()
    assert len(counted) == len(text)
    for r in counted:
        n = len(bpe.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 512)
    for r in queries.op7_sentencepiece(spark, SF).collect():
        ids = pieces.encode(text[r["doc_id"]])
        assert r["nbest"][0]["ids"] == ids and r["round_trip"]
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert len({tuple(x["ids"]) for x in r["nbest"]}) == len(r["nbest"])
