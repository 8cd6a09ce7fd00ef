"""What error values mean, in words."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarmill.functions.packet import ERRORS as PACKET

PAGE = {
    "no_capture": "no page starts here",
    "bad_version": "the page's version isn't 0",
    "truncated": "the page is cut short",
    "bad_checksum": "the page's checksum doesn't match its bytes",
}
STREAM = {
    "no_audio_stream": "no stream of this codec in the file",
    "invalid_id_header": "the identification header is missing or malformed",
    "unsupported_version": "the identification header's version is above 15",
    "invalid_comment_header": "the comment header is missing or malformed",
}
ENCODER = {
    "bad_frame_size": "frames have 2.5 to 20 ms (transform), 10 or 20 ms (hybrid) or 10 to 60 ms (speech) at 48 kHz",
    "packet_too_small": "the frame can't be coded in the packet's bytes",
}
ALL = PACKET | PAGE | STREAM | ENCODER


def message(error: Column) -> Column:
    """The sentence of an error value; null for null, the value itself if it is not known."""
    known = F.create_map(*map(F.lit, chain.from_iterable(ALL.items())))
    return F.coalesce(F.element_at(known, error), error)
