"""Operators on single texts against plain or library versions of the same work."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from headway.llm import bpe, chat, html_text, langid, matroska, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "aaaaaaaa aaa aaaaa", "a  b   c \t   d\r\n\x1c\x85 e", "don't I'LL we've 'S x's", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endof",
       "日本語テキスト と 漢字", "é́ ñ ² Ⅷ ٣٤ 12345 ½", "🙂🙂 👩‍👩‍👧 flags 🇩🇪", "\x00\x01�", "x" * 20000, "ab" * 9000 + " " * 300, "!!!??? --- ###   "]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "src") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, score string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def fuzz(n, seed=3):
    rng = random.Random(seed)
    pool = "abcdefghijklmnop ABC123   .,!?'\n\t\r" + "éüß ñ漢字ё  　²Ⅷ½🙂‍́\x1f\x85" + "'s've're"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 200))) for _ in range(n)]


def test_bpe_matches_the_tokenizer_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.bpe_file())
    texts = ODD + fuzz(400) + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = by_id(bpe.round_trip(documents(spark, texts), queries.bpe_file(), ["doc_id"]))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i]["n_tokens"] == len(ids), repr(t)[:80]
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_decodes_what_it_encodes(spark):
    rows = documents(spark, ODD)
    back = bpe.decode(bpe.encode(rows, queries.bpe_file(), ["doc_id"]), queries.bpe_file(), ["doc_id"])
    assert {k: r["text"] for k, r in by_id(back).items()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(rows.limit(0), queries.bpe_file(), ["doc_id"]).count() == 0


def test_bpe_without_merges_and_with_files_it_does_not_support(spark, tmp_path):
    import json

    with open(queries.bpe_file(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = []
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(spec))
    rows = documents(spark, ["ab c", "", None, "é"])
    assert {k: r["n_tokens"] for k, r in by_id(bpe.encode(rows, str(plain), ["doc_id"])).items()} == {0: 4, 1: 0, 2: 0, 3: 2}
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(other))


def test_kept_columns_give_way_to_added_ones(spark):
    rows = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, other string")
    rows = rows.withColumns({c: F.lit("old") for c in ("ids", "n_tokens", "lang_pred", "score", "feature", "n_chars")})
    keep = [c for c in rows.columns if c != "text"]
    coded = bpe.encode(rows, queries.bpe_file(), keep)
    assert sorted(coded.columns) == sorted(rows.drop("text").columns) and coded.first()["n_tokens"] == 2 and coded.first()["score"] == "old"
    assert bpe.decode(coded.withColumn("text", F.lit("old")), queries.bpe_file(), [*coded.columns, "text"]).first()["text"] == "a b"
    assert langid.predict(rows, langid.fit(rows.withColumn("lang", F.lit("en"))), keep).first()["lang_pred"] == "en"
    assert html_text.main_text(rows, [*keep, "text"], "text").first()["n_chars"] == 3
    assert "packets=1;" in matroska.stored_features(rows, keep).first()["feature"]


def test_matroska_key_frames_of_laced_groups():
    frames = [b"a", b"b", b"c"]
    block = matroska.element(matroska.BLOCK, matroska.laced_block(1, 0, frames, 1))
    refers = matroska.element(matroska.REFERENCE, b"\xff")
    time = matroska.element(matroska.CLUSTER_TIME, b"\x00")
    groups = [matroska.element(matroska.BLOCK_GROUP, x) for x in (block, block + refers, refers + block, block)]
    data = matroska._HEADER + b"\x18\x53\x80\x67\xff" + matroska._TRACK + matroska.element(matroska.CLUSTER, time + b"".join(groups))
    assert [p[4] for p in matroska.parse(data)["packets"]] == [True] * 3 + [False] * 6 + [True] * 3


def test_matroska_stores_payloads(spark):
    texts = [*ODD, "z" * (576 * 3), "w" * 700_000]
    got = by_id(matroska.stored_features(documents(spark, texts), ["doc_id"]))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (size - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), size)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        media = matroska.mux(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"packets={size // 576};" in r["feature"]


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_matroska_reads_every_lacing(lacing):
    rng = random.Random(lacing)
    sizes = [7] if lacing == 0 else [300] * 5 if lacing == 2 else [rng.choice([0, 3, 254, 255, 256, 1000, 20000]) for _ in range(9)]
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    block = matroska.element(matroska.SIMPLE_BLOCK, matroska.laced_block(1, -5, frames, lacing))
    time = matroska.element(matroska.CLUSTER_TIME, (1000).to_bytes(2, "big"))
    body = time + block
    for cluster in (matroska.element(matroska.CLUSTER, body), b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + body):  # the second of unknown size
        data = matroska._HEADER + b"\x18\x53\x80\x67\xff" + matroska._TRACK + cluster + cluster
        got = matroska.parse(data)
        assert got["error"] is None and got["clusters"] == 2
        assert [data[o : o + s] for _, _, o, s, *_ in got["packets"]] == frames * 2
        assert got["packets"][0][:2] == (1, 995_000_000) and got["packets"][0][5] == matroska.LACING[lacing]


def test_matroska_packet_table_and_broken_media(spark):
    media = matroska.mux(bytes(range(256)) * 9)
    rows = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"")), (4, bytearray(media[:900])), (5, bytearray(b"\x00" * 40))], "doc_id long, media binary")
    got = matroska.packet_table(rows, ["doc_id"]).collect()
    first = [r for r in got if r["doc_id"] == 1]
    assert [r["packet"] for r in first] == [0, 1, 2, 3] and b"".join(media[r["offset"] : r["offset"] + r["size"]] for r in first) == bytes(range(256)) * 9
    assert [r["time_ns"] for r in first] == [0, 72_000_000, 144_000_000, 216_000_000]
    assert not [r for r in got if r["doc_id"] in (2, 3)]
    assert all([r["error"] for r in got if r["doc_id"] == i][-1] for i in (4, 5))
    cues = matroska.parse(matroska.mux(b"x" * 400_000))
    assert len(cues["cues"]) == cues["clusters"] == 3 and [c[2] for c in cues["cues"]] == sorted({p[6] for p in cues["packets"]})


def test_chat_reads_back_what_it_formats(spark):
    rng = random.Random(1)
    texts = ["", "a", "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "\\", "\\\\<|", "<|<|start|>|>", "x\n<|next|>\n", "🙂<|text|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to<|ol", None]), rng.choice([*texts, None])) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 3, "user", "no id"), (7, None, "assistant", "no turn"), *rows[:5]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = chat.format_chats(df.where("conv_id = 7")).first()["formatted"]
    assert text.startswith("<|start|>") and text.endswith("<|end|>")
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_merges_adjacent_turns_of_a_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")], "conv_id long, turn long, role string, text string")
    text = chat.format_chats(df).first()["formatted"]
    assert text == "<|start|>user<|text|>a<|next|>b<|end|><|start|>assistant<|text|>c<|end|><|start|>user<|text|>d<|end|>"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n, low, high = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 150 and right / n > 0.97 and 0 <= low <= high <= 1


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = documents(spark, [None, "", "123 ### !!", "Ж", "the and of this with the", "the and of this with the", "x" * 300_000])
    got = by_id(langid.predict(odd, model, ["doc_id", "n_tokens"]))
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(got[i]["score"] == 0 for i in range(3))
    assert got[3]["lang_pred"] != "und" and got[4]["lang_pred"] == "en" and got[4]["score"] == got[5]["score"]
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, none, ["doc_id"]).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'fr'"))
    assert by_id(langid.predict(odd, one, ["doc_id"]))[4]["lang_pred"] == "fr"


def test_language_without_doubt_and_with(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')")
    model = langid.fit(docs)
    texts = ["the and of this with the from that", "der die und nicht mit einer keit", "x", "zz q", "", "1 2 3", "the die and der of und"]
    rows = by_id(langid.predict(documents(spark, texts), model, ["doc_id"]))
    assert [rows[i]["ambiguous"] for i in range(6)] == [False, False, True, True, False, False] and rows[6]["score"] < rows[0]["score"]
    flags = langid.predict(docs, model, ["doc_id"]).agg(F.count_if("ambiguous"), F.count("*")).first()
    assert 0 < flags[0] < 0.05 * flags[1]


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2) + (code.shape[1] * (1 - (code[:, None] == code[None]).any(axis=2)))
        assert code.shape[0] == n and min(apart[i][j] for i in range(n) for j in range(i)) >= (1 if n < 4 else 3)


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a="<p>no</p>";</script></head><body class="page">
<header><a href="/">Site</a><h2>Slogan of the site, no</h2></header><nav><ul><li><a href=x>No</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, we do, and you agree to all of them, which is a long notice.</p></div>
<div id="wrap"><div class="col {c}">{article}</div>
<aside><p>Sidebar text, which is fairly long, with commas, and more, and more, and still more words to read.</p></aside>
<div id="sidebar-2"><p>Another sidebar, long enough to count as a paragraph, with commas, and so on and so forth.</p></div>
<section class="comments"><h3>Comments</h3><p>First, I think, this is a very long comment, really, with many, many commas, and words, to draw points.</p></section></div>
<form><p>Sign up, now, for our long newsletter, please, do it, it is very good, and free, and weekly.</p><input></form>
<footer><p>Copyright, all rights reserved, in all the countries, of the world, forever, and ever.</p></footer></body></html>"""
BODY = """<h1>Title &amp; more</h1><p>First  paragraph,\n with&nbsp;space, commas &lt;b&gt; and <b>bold</b> text that is long enough to count.
<p>Second paragraph: unclosed, but fine, with <a href=y>a link</a>, and a caf&eacute;.<ul><li>One item</li><li>Two items</ul><p>Short.</p><blockquote>A quote, said somebody, at some length, in the text.</blockquote>"""
TEXT = "Title & more\nFirst paragraph, with space, commas <b> and bold text that is long enough to count.\nSecond paragraph: unclosed, but fine, with a link, and a café.\nOne item\nTwo items\nShort.\nA quote, said somebody, at some length, in the text."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "{}", "<div><div>{}</div></div>"])
def test_main_text_of_a_page(wrap):
    assert html_text.extract(PAGE.replace("{c}", "x").replace("{article}", wrap.replace("{}", BODY))) == TEXT


@pytest.mark.parametrize("names", ["post type-post tag-politics hentry", "layout has-sidebar", "content side-by-side", "entry-content with-comments", "side-by-side"])
def test_main_text_is_not_pruned_by_parts_of_names(names):
    assert html_text.extract(PAGE.replace("{c}", "x").replace("{article}", f"<div class='{names}'>{BODY}</div>")) == TEXT


@pytest.mark.parametrize("names", ["post-comments", "main-menu", "sidebar-content", "entry-meta", "comments"])
def test_main_text_leaves_out_named_surroundings(names):
    beside = f"<div class='{names}'><p>Something beside it, long enough, with commas, and more, to count as a paragraph of its own.</p></div>"
    assert html_text.extract(PAGE.replace("{c}", "x").replace("{article}", f"<div class='post-content'>{BODY}</div>{beside}")) == TEXT


def test_main_text_of_a_page_that_names_alone_would_empty():
    assert html_text.extract(f"<body><div class='widget'>{BODY}</div></body>") == TEXT
    assert html_text.extract("<body><div class='ad'><p>Buy this, now, and that, too.</p></div></body>") == ""


def test_main_text_edges(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "just text &amp; more"), (4, "u", "<p>a<p>b<br>c"), (5, "u", "<div>" * 5000 + "deep, deep text"), (6, "u", "<<<>>> <p <b>x</b>"), (7, "u", "<!-- x"), (7, "u", "<!-- x")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df, ["page_id", "url"]).orderBy("page_id").collect()]
    assert got[:5] == [(1, "", 0), (2, "", 0), (3, "just text & more", 16), (4, "a\nb c", 5), (5, "deep, deep text", 15)] and got[6] == got[7] == (7, "", 0)
    assert html_text.main_text(df.limit(0), ["page_id"]).count() == 0
