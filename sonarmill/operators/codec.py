"""Packets to samples and back: keyed folds over the speech and transform layers.

A stream's packets depend on those before them, so decoding and encoding are
folds (``streaming.fold``): one definition for batch and Structured Streaming,
parallel over streams. Streams of the public format need its energy model and speech
codebooks as parameters (``Tables``); by default these are built by rule.

Nulls: a null packet is a lost one and is concealed with the last packet's length;
a null frame of samples is silence as long as the last one. Broken packets give
their framing error and leave the stream as it was. Repeated rows are packets each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.functions import band_codec, framing
from sonarmill.functions.analysis import AFFORDABLE
from sonarmill.functions.entropy import Decoder, Encoder
from sonarmill.functions.packet import configurations
from sonarmill.functions.signal import low_passed
from sonarmill.functions.speech_codec import SpeechDecoder, SpeechEncoder, speech_packet
from sonarmill.functions.speech_tables import SpeechTables
from sonarmill.functions.transform import window
from sonarmill.functions.transform_codec import END_BAND, RATE, FrameCodec, demand
from sonarmill.sources import container
from sonarmill.streaming.fold import Fold, fold_batch, fold_stream

DECODED = "seq long, channels int, samples long, pcm array<float>, final_range long, concealed boolean, error string"
ENCODED = "seq long, data binary, final_range long, samples long, error string"
MAX_PACKET = 1275
FRAME_MS = {25: 0, 50: 1, 100: 2, 200: 3}


SPEECH_KHZ = {"narrow": 8, "medium": 12, "wide": 16}
HYBRID_START = 17
DC_POLE = 3 * 2 * np.pi / RATE
BEFORE_SUPPRESSION_MS, MOST_SUPPRESSED_MS = 200, 400


@dataclass
class Tables:
    """What streams of the public format must bring along."""

    model: band_codec.CoarseModel = band_codec.plain_model
    speech: SpeechTables = field(default_factory=SpeechTables)


def layout_ok(streams: int, coupled: int, mapping: list[int]) -> bool:
    return 1 <= streams and 0 <= coupled <= streams and streams + coupled <= 255 and all(m == 255 or 0 <= m < streams + coupled for m in mapping)


@dataclass
class PacketDecoder(Fold):
    """Packets (seq, data) of one stream to samples at 48 kHz (or a divisor of it, ``rate``).

    With ``recover`` a lost packet waits for the next one, which may hold a copy of it.
    """

    channels: int = 2
    rate: int = RATE
    tables: Tables = field(default_factory=Tables)
    recover: bool = False
    codec: FrameCodec = field(init=False)
    tenths: int = 200
    count: int = 1
    mode: str = "transform"
    top: int = 21
    waiting: list = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.channels not in (1, 2) or RATE % self.rate or RATE // self.rate not in (1, 2, 3, 4, 6):
            raise ValueError("channels are 1 or 2, rates 48000, 24000, 16000, 12000 or 8000")
        self.codec = FrameCodec(self.channels, self.tables.model, every=RATE // self.rate)
        self.speech = SpeechDecoder(self.channels, self.tables.speech)
        self.final_range = 0

    def frame(self, data: bytes, coded: int, bandwidth: str) -> np.ndarray:
        """Samples of a frame in the mode at hand."""
        lm = FRAME_MS.get(self.tenths, 3)
        if len(data) <= 1:
            return self.lost_frame()
        if self.mode == "transform":
            out = self.codec.decode(data, lm, coded, 0, self.top)
            self.final_range = self.codec.final_range
            return out
        wire = band_codec.Reader(Decoder(data), len(data))
        out = self.speech.decode(wire, self.tenths // 10, SPEECH_KHZ.get(bandwidth, 16), coded)
        hybrid = self.mode == "hybrid"
        extra, at_start = b"", False
        if wire.room(37 if hybrid else 17) and (not hybrid or wire.bit(False, 12)):
            at_start = bool(wire.bit(False, 1))
            size = wire.uniform(0, 256) + 2 if hybrid else len(data) - (wire.tell() + 7 >> 3)
            if 0 < size and 8 * (len(data) - size) >= wire.tell():
                extra = data[len(data) - size :]
                wire.bits -= 8 * size
                wire.coder.shrink(len(data) - size)
        if hybrid:
            out = out + self.codec.decode(b"", lm, coded, HYBRID_START, self.top, wire)
        self.final_range = wire.coder.range
        if extra:
            out = self._joined(out, extra, at_start, coded)
        return out

    def _joined(self, out: np.ndarray, extra: bytes, at_start: bool, coded: int) -> np.ndarray:
        """Cross-fades a 5 ms transform frame in at a change of modes."""
        codec = FrameCodec(self.channels, self.tables.model, every=RATE // self.rate)
        short = codec.decode(extra, 1, coded, 0, self.top)
        self.final_range ^= codec.final_range
        fade = window(120) ** 2
        if at_start:
            out[:, :120] = short[:, :120]
            out[:, 120:240] = (1 - fade) * short[:, 120:] + fade * out[:, 120:240]
        else:
            out[:, -120:] = (1 - fade) * out[:, -120:] + fade * short[:, 120:]
            self.codec = codec
        return out

    def frames(self, parsed: framing.Frames) -> tuple[np.ndarray, bool, str | None]:
        """(samples by channel, whether concealed, error) of a parsed packet."""
        mode, bandwidth, self.tenths = configurations()[parsed.header >> 3][1:4]
        if mode == "transform" and self.mode != "transform":
            self.codec = FrameCodec(self.channels, self.tables.model, every=RATE // self.rate)
        if mode != "transform" and self.mode == "transform":
            self.speech = SpeechDecoder(self.channels, self.tables.speech)
        self.mode, self.top, self.count = mode, END_BAND[bandwidth], len(parsed.frames)
        parts = [self.frame(f, 2 if parsed.header & 4 else 1, bandwidth) for f in parsed.frames]
        return np.concatenate(parts, axis=1), all(len(f) <= 1 for f in parsed.frames), None

    def lost_frame(self) -> np.ndarray:
        if self.mode == "transform":
            return self.codec.conceal(FRAME_MS[self.tenths], 0, self.top)
        out = self.speech.conceal(self.tenths // 10)
        return out + self.codec.conceal(FRAME_MS[self.tenths], HYBRID_START, self.top) if self.mode == "hybrid" else out

    def lost(self) -> np.ndarray:
        """Samples in place of a packet that did not come."""
        return np.concatenate([self.lost_frame() for _ in range(self.count)], axis=1)

    def recovered(self, data: bytes | None) -> np.ndarray | None:
        """The packet before, from the copy in this one, if there is one of the same kind."""
        try:
            parsed = framing.split(data or b"")
        except framing.FramingError:
            return None
        mode, bandwidth, tenths = configurations()[parsed.header >> 3][1:4]
        if mode != "speech" or self.mode != "speech" or len(parsed.frames[0]) < 2:
            return None
        self.tenths, self.count = tenths, 1
        frame = parsed.frames[0]
        return self.speech.recover(band_codec.Reader(Decoder(frame), len(frame)), tenths // 10, SPEECH_KHZ[bandwidth], 2 if parsed.header & 4 else 1)

    def _row(self, seq: int, pcm: np.ndarray | None, concealed: bool, error: str | None = None) -> dict:
        return _decoded(seq, pcm, self.channels, RATE // self.rate, self.final_range, concealed, error)

    def _late(self, data: bytes | None) -> list[dict]:
        """Rows of the packets that were waited for."""
        out = []
        for k, seq in enumerate(self.waiting):
            pcm = self.recovered(data) if k == len(self.waiting) - 1 else None
            out.append(self._row(seq, self.lost() if pcm is None else pcm, True))
        self.waiting = []
        return out

    def step(self, row: dict) -> list[dict]:
        if row["data"] is None:
            if self.recover:
                self.waiting.append(row["seq"])
                return []
            return [self._row(row["seq"], self.lost(), True)]
        data = bytes(row["data"])
        before = self._late(data)
        try:
            pcm, concealed, error = self.frames(framing.split(data))
        except framing.FramingError as broken:
            pcm, concealed, error = None, False, broken.args[0]
        return [*before, self._row(row["seq"], pcm, concealed, error)]

    def end(self) -> list[dict]:
        return self._late(None)


def _decoded(seq: int, pcm: np.ndarray | None, channels: int, every: int, final_range: int, concealed: bool, error: str | None) -> dict:
    samples = pcm[:, ::every] if pcm is not None else None
    return {
        "seq": seq,
        "channels": channels,
        "samples": None if samples is None else samples.shape[1],
        "pcm": None if samples is None else samples.T.ravel().astype(np.float32).tolist(),
        "final_range": final_range,
        "concealed": concealed,
        "error": error,
    }


@dataclass
class MultistreamDecoder(Fold):
    """Multistream packets (seq, data): the first ``coupled`` streams are stereo, ``mapping`` routes decoded channels (255: silence)."""

    streams: int = 1
    coupled: int = 0
    mapping: tuple[int, ...] = (0,)
    tables: Tables = field(default_factory=Tables)
    decoders: list[PacketDecoder] = field(init=False)

    def __post_init__(self) -> None:
        if not layout_ok(self.streams, self.coupled, list(self.mapping)):
            raise ValueError("no such layout")
        self.decoders = [PacketDecoder(2 if k < self.coupled else 1, RATE, self.tables) for k in range(self.streams)]

    def decoded(self, data: bytes | None) -> tuple[np.ndarray | None, bool, str | None, int]:
        if data is None:
            got = [(d.lost(), True, None) for d in self.decoders]
        else:
            try:
                parsed = framing.split_streams(data, self.streams)
            except framing.FramingError as broken:
                return None, False, broken.args[0], 0
            tenths = {len(p.frames) * configurations()[p.header >> 3][3] for p in parsed}
            if len(tenths) > 1:
                return None, False, "bad_frame_count", 0
            got = [d.frames(p) for d, p in zip(self.decoders, parsed, strict=True)]
        error = next((e for _, _, e in got if e), None)
        final = 0
        for d in self.decoders:
            final ^= d.final_range
        if error:
            return None, False, error, final
        # Channels in order of the streams are the numbers that the mapping names.
        flat = [c for pcm, _, _ in got for c in pcm]
        silent = np.zeros_like(flat[0])
        return np.array([silent if m == 255 else flat[m] for m in self.mapping]), all(c for _, c, _ in got), None, final

    def step(self, row: dict) -> list[dict]:
        pcm, concealed, error, final = self.decoded(None if row["data"] is None else bytes(row["data"]))
        return [_decoded(row["seq"], pcm, len(self.mapping), 1, final, concealed, error)]


@dataclass
class FileDecoder(Fold):
    """Packets (packet_no, data, granule, eos) of one contained stream: header, tags, then audio.

    Output is trimmed: the pre-skip at the start goes, and what lies behind the last granule; the header's gain is applied.
    """

    tables: Tables = field(default_factory=Tables)
    head: dict | None = None
    error: str | None = None
    decoder: MultistreamDecoder | None = None
    position: int = 0

    def step(self, row: dict) -> list[dict]:
        number, data = row["packet_no"], row["data"]
        if number == 0:
            try:
                self.head = container.parse_head(bytes(data))
                h = self.head
                streams, coupled, mapping = (h["stream_count"], h["coupled_count"], h["mapping"]) if h["family"] else (1, h["channel_count"] - 1, list(range(h["channel_count"])))
                self.decoder = MultistreamDecoder(streams, coupled, tuple(mapping), self.tables)
            except ValueError as broken:
                self.error = broken.args[0]
            return []
        if number == 1:
            return []
        if self.decoder is None:
            return [_decoded(number, None, 0, 1, 0, False, self.error or "invalid_id_header")]
        pcm, concealed, error, final = self.decoder.decoded(None if data is None else bytes(data))
        if pcm is not None:
            start, self.position = self.position, self.position + pcm.shape[1]
            stop = pcm.shape[1]
            if row["eos"] and row["granule"] is not None:
                stop = max(0, min(stop, int(row["granule"]) - start))
            pcm = pcm[:, min(stop, max(0, self.head["pre_skip"] - start)) : stop] * 10 ** (self.head["output_gain_q8"] / 256 / 20)
        return [_decoded(number, pcm, len(self.decoder.mapping), 1, final, concealed, error)]


@dataclass
class PacketEncoder(Fold):
    """Frames (seq, pcm) of one stream, interleaved at 48 kHz, 2.5 to 60 ms each, to packets of one frame.

    ``mode`` is transform, speech, hybrid or auto (by rate, frame length and the smoothed share of high
    frequencies), ``bandwidth`` one of the format's or auto (by rate). ``dtx`` sends the header alone while silence
    lasts; ``copies`` adds a copy of the frame before to speech packets of one channel; ``vbr`` lets
    sizes follow the signal round the rate; ``coded_channels`` mixes stereo down or doubles mono;
    ``reject_dc`` takes out what is below some 3 Hz.
    """

    channels: int = 1
    kbps: float = 64.0
    bandwidth: str = "full"
    mode: str = "transform"
    dtx: bool = False
    copies: bool = False
    vbr: bool = False
    coded_channels: int | None = None
    reject_dc: bool = False
    tables: Tables = field(default_factory=Tables)
    drift: float = 0.0
    samples: int = 960
    idle: float = 0.0
    music: float = 0.5

    def __post_init__(self) -> None:
        self.coded = self.coded_channels or self.channels
        if self.bandwidth == "auto":
            self.bandwidth = self._affordable()
        bands = {"speech": ("narrow", "medium", "wide"), "hybrid": ("superwide", "full")}.get(self.mode, ("narrow", "wide", "superwide", "full"))
        if self.channels not in (1, 2) or self.coded not in (1, 2) or self.bandwidth not in bands or not 4 <= self.kbps <= 510 or self.mode not in ("transform", "speech", "hybrid", "auto"):
            raise ValueError("channels are 1 or 2, rates 4 to 510 kb/s, modes and bandwidths those of the format")
        self.codec = FrameCodec(self.coded, self.tables.model)
        self.speech: SpeechEncoder | None = None
        self.delay = np.zeros((self.coded, 0))
        self.dc = [0.0] * self.coded
        self.now = ""

    def _affordable(self) -> str:
        """The widest band of the mode that the rate can fill."""
        wide = next((name for rate, name in AFFORDABLE if self.kbps * 1000 / self.coded < rate), "full")
        order = {"speech": ("narrow", "medium", "wide"), "hybrid": ("superwide", "full")}.get(self.mode, ("narrow", "wide", "superwide", "full"))
        rank = ("narrow", "medium", "wide", "superwide", "full").index
        return max((b for b in order if rank(b) <= rank(wide)), key=rank, default=order[0])

    def _mode(self, x: np.ndarray, n: int) -> str:
        """The mode that suits a frame."""
        if self.mode != "auto":
            return self.mode
        if x.any():
            power = np.abs(np.fft.rfft(x.mean(axis=0))) ** 2
            high = float(power[len(power) // 6 :].sum() / max(power.sum(), 1e-20))  # above 4 kHz
            self.music += 0.2 * (min(1.0, 4 * high) - self.music)
        low = self.bandwidth in ("narrow", "wide")
        if n < 480 or (self.kbps > (24 if low else 40) and self.music > 0.25) or self.music > 0.7:
            return "transform"
        return "speech" if low or n > 960 else "hybrid"

    def _speech_encoder(self, khz: int, fresh: bool) -> SpeechEncoder:
        if fresh or self.speech is None or self.speech.khz != khz:
            self.speech = SpeechEncoder(self.coded, khz, self.tables.speech, self.copies)
        return self.speech

    def _frame(self, x: np.ndarray, size: int) -> tuple[int, bytes, int]:
        """(configuration, frame, final range)."""
        n = x.shape[1]
        mode = self._mode(x, n)
        fresh, self.now = mode != self.now, mode
        if mode == "speech":
            band = self.bandwidth if self.bandwidth in SPEECH_KHZ else "wide"
            data, final = speech_packet(self._speech_encoder(SPEECH_KHZ[band], fresh), x, size)
            return 4 * ("narrow", "medium", "wide").index(band) + (480, 960, 1920, 2880).index(n), data, final
        if fresh:
            self.codec = FrameCodec(self.coded, self.tables.model)
        lm = (120, 240, 480, 960).index(n)
        if mode == "transform":
            data = self.codec.encode(x, size, lm, 0, END_BAND[self.bandwidth])
            return 16 + 4 * ("narrow", "wide", "superwide", "full").index(self.bandwidth) + lm, data, self.codec.final_range
        # Hybrid: the speech layer's lag is made up for, so that both layers meet.
        speech = self._speech_encoder(16, fresh)
        if fresh:
            self.delay = np.zeros((self.coded, 120 - speech.lag))
        late = np.concatenate([self.delay, x], axis=1)
        self.delay = late[:, n:]
        wire = band_codec.Writer(Encoder(size), size)
        share = 8 * size * 0.6 if n == 960 else 8 * size * 0.65
        speech.encode(wire, late[:, :n], int(share))
        if wire.room(37):
            wire.bit(False, 12)
        self.codec.encode(x, size, lm, HYBRID_START, END_BAND[self.bandwidth], wire)
        return 12 + 2 * ("superwide", "full").index(self.bandwidth) + (480, 960).index(n), wire.coder.finish(), wire.coder.range

    def step(self, row: dict) -> list[dict]:
        pcm = np.zeros(self.channels * self.samples) if row["pcm"] is None else np.nan_to_num(np.asarray(row["pcm"], float), posinf=0.0, neginf=0.0)
        n, rest = divmod(len(pcm), self.channels)
        allowed = {"transform": (120, 240, 480, 960), "speech": (480, 960, 1920, 2880), "hybrid": (480, 960), "auto": (120, 240, 480, 960)}[self.mode]
        if rest or n not in allowed:
            return [{"seq": row["seq"], "error": "bad_frame_size"}]
        self.samples = n
        size = int(min(MAX_PACKET, max(2, self.kbps * 1000 * n / RATE / 8 - 1)))
        x = np.clip(pcm.reshape(n, self.channels).T, -2, 2)
        if self.coded < self.channels:
            x = x.mean(axis=0, keepdims=True)
        elif self.coded > self.channels:
            x = np.repeat(x, 2, axis=0)
        if self.reject_dc:
            low = [low_passed(v, DC_POLE, last) for v, last in zip(x, self.dc, strict=True)]
            x, self.dc = x - np.array(low), [float(v[-1]) for v in low]
        if self.vbr:
            # What was spent too much or too little is made up for within some fifty frames.
            wish = size * demand(x) - self.drift / 50
            self.drift += max(3.0, min(wish, 2 * size, MAX_PACKET)) - size
            size = int(max(3, min(wish, 2 * size, MAX_PACKET)))
        try:
            config, data, final = self._frame(x, size)
        except ValueError:
            return [{"seq": row["seq"], "error": "packet_too_small"}]
        self.idle = 0.0 if np.abs(x).max() > 1e-4 else self.idle + n / 48
        if self.dtx and self.idle > BEFORE_SUPPRESSION_MS:
            if self.idle > BEFORE_SUPPRESSION_MS + MOST_SUPPRESSED_MS:
                self.idle = float(BEFORE_SUPPRESSION_MS)
            else:
                data = b""
        return [{"seq": row["seq"], "data": bytes([config << 3 | (self.coded - 1) << 2]) + data, "final_range": final, "samples": n}]


class _Make:
    """A fold's maker that can be sent to the tasks."""

    def __init__(self, kind, options: dict):
        self.kind, self.options = kind, options

    def __call__(self) -> Fold:
        return self.kind(**self.options)


def _keyed(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + rest


def _folded(df: DataFrame, columns: list[str], keys: list[str], order: list[str], make: _Make, schema: str) -> DataFrame:
    rows = df.select(*keys, *columns)
    return (fold_stream if df.isStreaming else fold_batch)(rows, keys, order, make, _keyed(df, keys, schema))


def decode(df: DataFrame, keys: list[str], channels: int = 2, rate: int = RATE, tables: Tables | None = None, recover: bool = False) -> DataFrame:
    """(keys, seq, channels, samples, pcm, final_range, concealed, error) from packets (keys, seq, data)."""
    return _folded(df, ["seq", "data"], keys, ["seq"], _Make(PacketDecoder, {"channels": channels, "rate": rate, "tables": tables or Tables(), "recover": recover}), DECODED)


def decode_multistream(df: DataFrame, keys: list[str], streams: int, coupled: int, mapping: list[int], tables: Tables | None = None) -> DataFrame:
    """As ``decode`` for multistream packets; ``mapping`` has an entry for each output channel."""
    return _folded(df, ["seq", "data"], keys, ["seq"], _Make(MultistreamDecoder, {"streams": streams, "coupled": coupled, "mapping": tuple(mapping), "tables": tables or Tables()}), DECODED)


def encode(df: DataFrame, keys: list[str], channels: int = 1, kbps: float = 64.0, bandwidth: str = "full", mode: str = "transform", tables: Tables | None = None, **options) -> DataFrame:
    """(keys, seq, data, final_range, samples, error) from frames (keys, seq, pcm); further options are those of ``PacketEncoder``."""
    options |= {"channels": channels, "kbps": kbps, "bandwidth": bandwidth, "mode": mode, "tables": tables or Tables()}
    return _folded(df, ["seq", "pcm"], keys, ["seq"], _Make(PacketEncoder, options), ENCODED)


def decode_files(files: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(path, serial, seq, ...) as ``decode``, of the audio streams of containers (path, content)."""
    packets = container.packets_of(container.pages_of(files))
    audio = container.first_audio_serial(container.pages_of(files))
    rows = packets.join(audio, ["path", "serial"], "left_semi")
    return _folded(rows, ["packet_no", "data", "granule", "eos"], ["path", "serial"], ["packet_no"], _Make(FileDecoder, {"tables": tables or Tables()}), DECODED)


def encode_files(df: DataFrame, key: str, channels: int = 1, kbps: float = 64.0, pre_skip: int = 120, vendor: bytes = b"sonarmill") -> DataFrame:
    """(key, content): a container for each stream of frames (key, seq, pcm). The pre-skip covers the encoder's lag."""
    packets = encode(df, [key], channels, kbps).where("data is not null")
    return container.write_containers(packets.select(key, "seq", F.col("data")), key, "seq", container.make_head(channels, pre_skip), container.make_tags(vendor, []))
