"""Payloads that look like an ID3v1 tag where a stream's tag would be."""

import pytest

from tracegraph.llm import media

TAIL = b"x" * 65 + b"TAG" + b"x" * 124


@pytest.mark.parametrize("payload", [TAIL, b"y" * 1920 + TAIL])
def test_tag_in_the_payload(payload):
    raw = media.store(payload)
    assert raw[-128:-125] == b"TAG"
    assert media.load(raw) == payload and "ID3v1" not in media.scan(raw).tags
    tagged = media.scan(raw + b"TAG" + bytes(125))
    assert media.load(raw, tagged) == payload and tagged.tags[-1] == "ID3v1"


def test_tag_after_a_torn_frame():
    raw = media.store(b"x" * 1920)
    torn = media.scan(raw[:-50] + b"TAG" + bytes(125))
    assert len(torn.offsets) == 9 and torn.tags[-1] == "ID3v1"


def test_tag_in_a_text(spark):
    row = media.text_media(spark.createDataFrame([(1, TAIL.decode())], "doc_id long, text string")).first()
    assert row["payload_bytes"] == 192 and media.load(row["media"]) == TAIL
