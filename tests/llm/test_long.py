"""Very long texts and conversations, with all their values."""

import hashlib
import zlib

from tetragrid.llm import chat_format, media, warc
from tetragrid.llm.pieces import decode_pieces, encode_pieces, load_model

LONG = " ".join(f"längst{i} </turn> # \\ {i * 7919 % 1000}" for i in range(25_000))


def test_long_conversations(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 5)) for i in range(1, 3000)]
    turns += [(2, 0, "user", LONG), (2, 1, "assistant", LONG[::-1]), (3, 0, "assistant", None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(rows)).collect()}
    for conv in (1, 2, 3):
        own = [(role, text or "") for c, _, role, text in turns if c == conv]
        loss = "".join(text for role, text in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_texts_in_archives_images_and_pieces(spark):
    rows = [(1, LONG), (2, "x" * 1_500_000), (3, LONG), (4, "")]
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    images = {r.doc_id: r for r in media.media_columns(docs)[1].collect()}
    model = load_model(spark)
    pieces = {r.doc_id: r for r in decode_pieces(encode_pieces(docs, model), model).collect()}
    for i, text in rows:
        data = text.encode()
        payload = media.padded(data)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), 3 if i == 1 else None)
        assert (images[i].n_bytes, images[i].payload_sha256, images[i].tail_crc32) == (len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert pieces[i].decoded == text and bool(pieces[i].piece_ids) == bool(text)
    assert (images[1].shard, images[1].offset) == (images[3].shard, images[3].offset)
