import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nucleoframe.llm.packing import pack
from nucleoframe.llm.pieces import cut_texts
from nucleoframe.llm.queries import p9_packed, p10_pieces
from nucleoframe.llm.tokens import decode_bytes, encode, encode_column, safe_parts, VOCABULARY
from nucleoframe.session import table

TEXTS = [None, "", " ", "a", "Ça va?  Très\n\nbien… 日本語です。🙂", "x" * 200_000, "wort 12 " * 40_000, "<|endoftext|> a", "　\t\r\n  b", "don't we'll I'VE", "a" * 10 + "\x00b", "Ja/Nein/" * 30_000]


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_another_library(spark, other):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in encode_column(df, "text", ["doc_id"]).withColumn("back", decode_bytes(F.col("ids"))).collect()}
    for k, t in enumerate(TEXTS):
        assert rows[k]["ids"] == (other(t) if t else []), k
        assert bytes(rows[k]["back"]) == (t or "").encode()
    assert encode_column(df.limit(0), "text", ["doc_id"]).count() == 0


def test_real_texts(spark, other):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r["ids"] for r in encode_column(docs, "text", ["doc_id"]).collect()}
    assert all(got[r["doc_id"]] == other(r["text"] or "") for r in docs.select("doc_id", "text").collect())


def test_safe_parts_add_up():
    for t in ("wort 12 " * 40_000, "Ja 3a/ " * 9_000, TEXTS[4] * 5_000):
        parts = safe_parts(t, 1000)
        assert "".join(parts) == t and len(parts) > 10
        assert [i for p in parts for i in encode(p, VOCABULARY).tolist()] == [i for i in encode(t, VOCABULARY).tolist()]


def test_packing_keeps_every_token_and_wastes_little(spark):
    got = p9_packed(spark, "/root/testdata/sf0.01").toPandas()
    fill = got.groupby("container_id")["size"].sum()
    assert fill.max() <= 2048 and got["size"].sum() / (2048 * len(fill)) > 0.98
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r["doc_id"]: len(encode(r["text"] or "", VOCABULARY)) for r in docs.select("doc_id", "text").collect()}
    assert got.groupby("doc_id")["size"].sum().to_dict() == want
    assert set(got[got.duplicated("doc_id", keep=False)].doc_id) == {d for d, n in want.items() if n > 2048}


@pytest.mark.parametrize("sizes", [[], [None, 0], [10] * 25, [101, 100, 99, 1, 60, 40, 250], list(range(1, 100)) * 3])
def test_packing_of_odd_sizes(spark, sizes):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "i bigint, s bigint")
    rows = pack(df, "i", "s", 100, shard_rows=40).collect()
    fill = {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
    assert all(v <= 100 for v in fill.values()) and sum(fill.values()) == sum(s or 0 for s in sizes)
    assert {r["id"] for r in rows} == set(range(len(sizes)))


def test_packing_of_text_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(f"d{k % 40}", s) for k, s in enumerate([7, 13, 40, 60, 99, 0] * 12)], "i string, s int")
    rows = pack(df, "i", "s", 100, shard_rows=30).collect()
    fill = {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
    assert sorted(r["id"] for r in rows) == sorted(f"d{k % 40}" for k in range(72)) and all(v <= 100 for v in fill.values())


def test_pieces_give_back_the_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = p10_pieces(spark, "/root/testdata/sf0.01").toPandas().sort_values("piece_no")
    assert set(got.doc_id) == {d for d, t in texts.items() if t and len(encode(t, VOCABULARY)) > 1024}
    from nucleoframe.llm.tokens import encoding

    for doc, g in got.groupby("doc_id"):
        ids, part = encode(texts[doc], VOCABULARY).tolist(), lambda a, b: encoding(VOCABULARY).decode_bytes(ids[a:b]).decode()
        rows = list(g.itertuples())
        assert rows[0].token_start == 0 and rows[-1].token_end == len(ids)
        for k, r in enumerate(rows):
            assert r.token_end - r.token_start <= 1024 and r.text == part(r.token_start, r.token_end)
            if k:
                assert r.new_start == rows[k - 1].token_end and 0 <= r.new_start - r.token_start <= 64
    assert (got.cut != "c").mean() > 0.9


def test_pieces_prefer_the_strongest_boundary(spark):
    text = "One two three four. Five six seven eight nine.\n\nTen eleven twelve (Applause) thirteen fourteen Dr. Who fifteen sixteen seventeen eighteen nineteen twenty."
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "日" * 100)], "d bigint, text string")
    rows = [r for r in cut_texts(df, "d", "text", 16, 0).orderBy("d", "piece_no").collect()]
    mine = [r["text"] for r in rows if r["d"] == 1]
    assert "".join(mine) == text and mine[0].endswith("\n\n") and mine[1].endswith("(Applause)")
    assert "".join(r["text"] for r in rows if r["d"] == 4) == "日" * 100
    assert {r["d"] for r in rows} == {1, 4}


def test_boundaries_by_plain_rules():
    import re
    import random

    from nucleoframe.llm.pieces import ABBREVIATIONS, KINDS, boundary_kinds

    def plain(text):
        """Each place by itself."""
        kinds = []
        for i in range(len(text) + 1):
            before, after = text[:i], text[i:]
            if not after or re.search(r"\n\s*\Z", before) and not re.match(r"\s", after):
                kinds.append("P")
                continue
            sentence = re.search(r"([.!?…])[\"'»”’)\]]*\Z", before)
            ends = False
            if sentence and re.match(r"\s", after):
                word = re.search(r"\w*\Z", before[: sentence.start()])[0]
                ends = not (sentence[1] == "." and (len(word) == 1 or word in ABBREVIATIONS.split() or word.isdigit()))
            if re.search(r"[)\]]\Z", before) and re.match(r"\s", after) or before.endswith("）"):
                kinds.append("I")
            elif ends or re.search(r"[。！？][」』”）]*\Z", before) and not re.match(r"[」』”）]", after):
                kinds.append("S")
            elif re.search(r"\S\Z", before) and re.match(r" \S", after) or before.endswith("\n") and re.match(r"\S", after):
                kinds.append("W")
            else:
                kinds.append("c")
        return "".join(kinds)

    rnd = random.Random(2)
    texts = ["", "Mr. X. said (so.) Now\n\n then.", "Art. 12. no. 5", "。」）x"] + ["".join(rnd.choice("aZ1٣ .!?…。」）)]\"'»\n\tMr9²") for _ in range(rnd.randrange(30))) for _ in range(1500)]
    for t in texts:
        assert "".join(KINDS[k] for k in boundary_kinds(t)) == plain(t), repr(t)


def test_long_texts_take_time_in_proportion(spark):
    import time

    seconds = []
    for n in (50_000, 400_000):
        df = spark.createDataFrame([(1, "Words go on. " * n)], "doc_id bigint, text string")
        began = time.time()
        rows = cut_texts(df, "doc_id", "text", 1024, 64).select("piece_no", "token_end", "new_start").collect()
        seconds.append(time.time() - began)
        assert len(rows) > n // 300 and all(r["token_end"] > r["new_start"] for r in rows)
    assert seconds[1] < 16 * max(seconds[0], 1.0)
