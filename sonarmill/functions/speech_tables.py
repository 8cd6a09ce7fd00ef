"""Tables of the speech layer (RFC 6716, section 4.2).

Small tables are stated. The large codebooks (line-spectral vectors and their
selectors, shell codes) are a parameter: ``SpeechTables`` builds them by rule,
``SpeechTables.from_rows`` takes them from a table (name, place, value), which streams of
the public format need.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import comb, pi, sin

#: Fixed values of the format: falling frequency tables of the side information.
TYPE_ACTIVE, TYPE_INACTIVE = [232, 158, 10, 0], [230, 0]
GAIN_HIGH = ([224, 112, 44, 15, 3, 2, 1, 0], [254, 237, 192, 132, 70, 23, 4, 0], [255, 252, 226, 155, 61, 11, 2, 0])
GAIN_DELTA = [250, 245, 234, 203, 71, 50, 42, 38, 35, 33, 31, 29, *range(28, -1, -1)]
UNIFORM = {3: [171, 85, 0], 4: [192, 128, 64, 0], 5: [205, 154, 102, 51, 0], 6: [213, 171, 128, 85, 43, 0], 8: [224, 192, 160, 128, 96, 64, 32, 0]}
SPECTRUM_MORE = [100, 40, 16, 7, 3, 1, 0]
INTERPOLATION = [243, 221, 192, 181, 0]
LAG_HIGH = [253, 250, 244, 233, 212, 182, 150, 131, 120, 110, 98, 85, 72, 60, 49, 40, 32, 25, 19, 15, 13, 11, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
LAG_DELTA = [210, 208, 206, 203, 199, 193, 183, 168, 142, 104, 74, 52, 37, 27, 20, 14, 10, 6, 4, 2, 0]
CONTOUR = {
    (True, 4): [188, 176, 155, 138, 119, 97, 67, 43, 26, 10, 0],
    (True, 2): [113, 63, 0],
    (False, 4): [223, 201, 183, 167, 152, 138, 124, 111, 98, 88, 79, 70, 62, 56, 50, 44, 39, 35, 31, 27, 24, 21, 18, 16, 14, 12, 10, 8, 6, 4, 3, 2, 1, 0],
    (False, 2): [165, 119, 80, 61, 47, 35, 27, 20, 14, 9, 4, 0],
}
PERIODICITY = [179, 99, 0]
LONG_TERM = (
    [71, 56, 43, 30, 21, 12, 6, 0],
    [199, 165, 144, 124, 109, 96, 84, 71, 61, 51, 42, 32, 23, 15, 8, 0],
    [241, 225, 211, 199, 187, 175, 164, 153, 142, 132, 123, 114, 105, 96, 88, 80, 72, 64, 57, 50, 44, 38, 33, 29, 24, 20, 16, 12, 9, 5, 2, 0],
)
LONG_TERM_SCALE = [128, 64, 0]
RECOVERY = {2: [203, 150, 0], 3: [215, 195, 166, 125, 110, 82, 0]}
LOW_BIT = [120, 0]
STEREO_JOINT = [249, 247, 246, 245, 244, 234, 210, 202, 201, 200, 197, 174, 82, 59, 56, 55, 54, 46, 22, 12, 11, 10, 9, 7, 0]
MID_ONLY = [64, 0]

#: Fixed values of the format: lags of the contours, long-term filters (in 1/128), their scales (in 1/16384),
#: offsets of the excitation (in 1/1024), stereo predictors (in 1/8192), least distances of line spectra (in 1/32768).
CONTOUR_LAGS = {
    (True, 4): ((0, 2, -1, -1, -1, 0, 0, 1, 1, 0, 1), (0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0), (0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0), (0, -1, 2, 1, 0, 1, 1, 0, 0, -1, -1)),
    (True, 2): ((0, 1, 0), (0, 0, 1)),
    (False, 4): (
        (0, 0, 1, -1, 0, 1, -1, 0, -1, 1, -2, 2, -2, -2, 2, -3, 2, 3, -3, -4, 3, -4, 4, 4, -5, 5, -6, -5, 6, -7, 6, 5, 8, -9),
        (0, 0, 1, 0, 0, 0, 0, 0, 0, 0, -1, 1, 0, 0, 1, -1, 0, 1, -1, -1, 1, -1, 2, 1, -1, 2, -2, -2, 2, -2, 2, 2, 3, -3),
        (0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1, -1, 1, 0, 0, 2, 1, -1, 2, -1, -1, 2, -1, 2, 2, -1, 3, -2, -2, -2, 3),
        (0, 1, 0, 0, 1, 0, 1, -1, 2, -1, 2, -1, 2, 3, -2, 3, -2, -2, 4, 4, -3, 5, -3, -4, 6, -4, 6, 5, -5, 8, -6, -5, -7, 9),
    ),
    (False, 2): ((0, 0, 1, -1, 1, -1, 2, -2, 2, -2, 3, -3), (0, 1, 0, 1, -1, 2, -1, 2, -2, 3, -2, 3)),
}
FILTERS = (
    ((4, 6, 24, 7, 5), (0, 0, 2, 0, 0), (12, 28, 41, 13, -4), (-9, 15, 42, 25, 14), (1, -2, 62, 41, -9), (-10, 37, 65, -4, 3), (-6, 4, 66, 7, -8), (16, 14, 38, -3, 33)),
    (
        (13, 22, 39, 23, 12), (-1, 36, 64, 27, -6), (-7, 10, 55, 43, 17), (1, 1, 8, 1, 1), (6, -11, 74, 53, -9), (-12, 55, 76, -12, 8), (-3, 3, 93, 27, -4), (26, 39, 59, 3, -8),
        (2, 0, 77, 11, 9), (-8, 22, 44, -6, 7), (40, 9, 26, 3, 9), (-7, 20, 101, -7, 4), (3, -8, 42, 26, 0), (-15, 33, 68, 2, 23), (-2, 55, 46, -2, 15), (3, -1, 21, 16, 41),
    ),
    (
        (-6, 27, 61, 39, 5), (-11, 42, 88, 4, 1), (-2, 60, 65, 6, -4), (-1, -5, 73, 56, 1), (-9, 19, 94, 29, -9), (0, 12, 99, 6, 4), (8, -19, 102, 46, -13), (3, 2, 13, 3, 2),
        (9, -21, 84, 72, -18), (-11, 46, 104, -22, 8), (18, 38, 48, 23, 0), (-16, 70, 83, -21, 11), (5, -11, 117, 22, -8), (-6, 23, 117, -12, 3), (3, -8, 95, 28, 4), (-10, 15, 77, 60, -15),
        (-1, 4, 124, 2, -4), (3, 38, 84, 24, -25), (2, 13, 42, 13, 31), (21, -4, 56, 46, -1), (-1, 35, 79, -13, 19), (-7, 65, 88, -9, -14), (20, 4, 81, 49, -29), (20, 0, 75, 3, -17),
        (5, -9, 44, 92, -8), (1, -3, 22, 69, 31), (-6, 95, 41, -12, 5), (39, 67, 16, -4, 1), (0, -6, 120, 55, -36), (-13, 44, 122, 4, -24), (81, 5, 11, 3, 7), (2, 0, 9, 10, 88),
    ),
)
FILTER_SCALE = (15565, 12288, 8192)
OFFSETS = ((100, 240), (32, 100))
STEREO_LEVELS = (-13732, -10050, -8266, -7526, -6500, -5000, -2950, -820, 820, 2950, 5000, 6500, 7526, 8266, 10050, 13732)
SPACING = {10: (250, 3, 6, 3, 3, 3, 4, 3, 3, 3, 461), 16: (100, 3, 40, 3, 3, 3, 5, 14, 14, 10, 11, 3, 8, 9, 7, 3, 347)}
QUANTISER_STEP = {10: 11796, 16: 9830}  # in 1/65536

#: Fixed values of the format: pulses of a block of 16 samples by rate level, levels by voicing, signs.
RATE_LEVELS = ([241, 190, 178, 132, 87, 74, 41, 14, 0], [223, 193, 157, 140, 106, 57, 39, 18, 0])
BLOCK_PULSES = (
    [125, 51, 26, 18, 15, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
    [198, 105, 45, 22, 15, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
    [213, 162, 116, 83, 59, 43, 32, 24, 18, 15, 12, 9, 7, 6, 5, 3, 2, 0],
    [239, 187, 116, 59, 28, 16, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
    [250, 229, 188, 135, 86, 51, 30, 19, 13, 10, 8, 6, 5, 4, 3, 2, 1, 0],
    [249, 235, 213, 185, 156, 128, 103, 83, 66, 53, 42, 33, 26, 21, 17, 13, 10, 0],
    [254, 249, 235, 206, 164, 118, 77, 46, 27, 16, 10, 7, 5, 4, 3, 2, 1, 0],
    [255, 253, 249, 239, 220, 191, 156, 119, 85, 57, 37, 23, 15, 10, 6, 4, 2, 0],
    [255, 253, 251, 246, 237, 223, 203, 179, 152, 124, 98, 75, 55, 40, 29, 21, 15, 0],
    [255, 254, 253, 247, 220, 162, 106, 67, 42, 28, 18, 12, 9, 6, 4, 3, 2, 0],
)
SIGNS = (254, 49, 67, 77, 82, 93, 99, 198, 11, 18, 24, 31, 36, 45, 255, 46, 66, 78, 87, 94, 104, 208, 14, 21, 32, 42, 51, 66, 255, 94, 104, 109, 112, 115, 118, 248, 53, 69, 80, 88, 95, 102)


def falling(weights: list[float]) -> list[int]:
    """A table of 256 for the weights: every symbol keeps at least one part."""
    total, n, out, seen = sum(weights), len(weights), [], 0.0
    for k, w in enumerate(weights):
        seen += w
        out.append(max(n - 1 - k, min(255 - k, round(256 - n - (256 - n) * seen / total) + n - 1 - k)))
    out[-1] = 0
    return out


@dataclass
class Spectra:
    """Codebook of line spectra of one order: first vectors (in 1/256 of the band), falling tables of their choice by voicing,
    for each vector and place which residual table and which predictor is meant, residual tables, predictors (in 1/256)."""

    order: int
    vectors: list[list[int]]
    choice: list[list[int]]
    table: list[list[int]]
    weight: list[list[int]]
    residual: list[list[int]]


def spectra_by_rule(order: int) -> Spectra:
    """Warped and rippled even spacings."""
    vectors = []
    for k in range(32):
        bend, phase = 0.75 + 0.09 * (k % 8), k // 8
        v = [256 * ((i + 1) / (order + 1)) ** bend + (0 if phase == 0 else 80 / order * sin(2 * pi * (phase * (i + 1) / order + phase / 4))) for i in range(order)]
        out, last = [], 0
        for i, x in enumerate(v):
            last = max(last + 4, min(round(x), 252 - 4 * (order - 1 - i)))
            out.append(last)
        vectors.append(out)
    residual = [falling([(0.35 + 0.06 * k) ** abs(j - 4) for j in range(9)]) for k in range(8)]
    return Spectra(order, vectors, [falling([1.0] * 32)] * 2, [[3 + i % 3 for i in range(order)]] * 32, [[150] * (order - 1)] * 32, residual)


def shells_by_rule() -> list[list[list[int]]]:
    """For four levels, from pairs of samples up: how t pulses split, broader than a fair coin would split them."""
    out = []
    for level in range(4):
        a = 0.7 + 0.5 * level
        out.append([[], *(falling([_rising(a, k) * _rising(a, t - k) * comb(t, k) for k in range(t + 1)]) for t in range(1, 17))])
    return out


def _rising(a: float, k: int) -> float:
    out = 1.0
    for j in range(k):
        out *= (a + j) / (1 + j / 8)
    return out


@dataclass
class SpeechTables:
    spectra: dict[int, Spectra] = field(default_factory=lambda: {n: spectra_by_rule(n) for n in (10, 16)})
    shells: list[list[list[int]]] = field(default_factory=shells_by_rule)

    @classmethod
    def from_rows(cls, rows: list[tuple[str, int, int]]) -> SpeechTables:
        """Of rows (name, place, value): vectors_N (32 N), choice_N (64), select_N (16 N: two nibbles of a pair of places, each three
        bits of table and one of predictor), predict_N (2 N - 2), residual_N (72) for N of 10 and 16, shell_0 to shell_3 (152)."""
        named: dict[str, dict[int, int]] = {}
        for name, place, value in rows:
            named.setdefault(name, {})[place] = value

        def take(name: str, n: int) -> list[int]:
            got = named.get(name, {})
            if sorted(got) != list(range(n)):
                raise ValueError(f"{name} needs places 0 to {n - 1}")
            return [got[k] for k in range(n)]

        spectra = {}
        for order in (10, 16):
            flat, choice, select = take(f"vectors_{order}", 32 * order), take(f"choice_{order}", 64), take(f"select_{order}", 16 * order)
            predict, residual = take(f"predict_{order}", 2 * order - 2), take(f"residual_{order}", 72)
            nibbles = [[x for e in select[k * order // 2 : (k + 1) * order // 2] for x in (e & 15, e >> 4)] for k in range(32)]
            spectra[order] = Spectra(
                order,
                [flat[k * order : (k + 1) * order] for k in range(32)],
                [choice[:32], choice[32:]],
                [[x >> 1 for x in row] for row in nibbles],
                [[predict[i + (x & 1) * (order - 1)] for i, x in enumerate(row[: order - 1])] for row in nibbles],
                [residual[9 * k : 9 * k + 9] for k in range(8)],
            )
        shells = []
        for level in range(4):
            flat, at, tables = take(f"shell_{level}", 152), 0, [[]]
            for t in range(1, 17):
                tables.append(flat[at : at + t + 1])
                at += t + 1
            shells.append(tables)
        return cls(spectra, shells)
