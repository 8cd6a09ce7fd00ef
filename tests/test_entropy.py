import itertools
import random

import pytest

from sonarmill.functions import entropy as e


def test_pulse_vectors_are_numbered_without_gaps():
    assert [e.pulse_vectors(3, k) for k in range(4)] == [1, 6, 18, 38]
    for n in range(1, 5):
        for k in range(6):
            every = [list(v) for v in itertools.product(range(-k, k + 1), repeat=n) if sum(map(abs, v)) == k]
            assert sorted(map(e.pulse_index, every)) == list(range(e.pulse_vectors(n, k)))
            assert all(e.pulse_vector(e.pulse_index(v), n, k) == v for v in every)


@pytest.mark.parametrize("seed", range(25))
def test_decoder_follows_encoder(seed):
    rng = random.Random(seed)
    enc, steps = e.Encoder(1275), []
    for _ in range(400):
        kind = rng.randrange(7)
        if kind == 0:
            total = rng.randint(2, 30000)
            first = rng.randrange(total)
            stop = rng.randint(first + 1, total)
            enc.symbol(first, stop, total)
            steps.append(lambda d, a=first, b=stop, t=total: a <= d.where(t) < b and d.take(a, b, t) is None)
        elif kind == 1:
            bit, odds = rng.random() < 0.3, rng.randint(1, 15)
            enc.bit(bit, odds)
            steps.append(lambda d, b=bit, o=odds: d.bit(o) == b)
        elif kind == 2:
            v = rng.randrange(4)
            enc.from_table(v, [200, 100, 20, 0], 8)
            steps.append(lambda d, v=v: d.from_table([200, 100, 20, 0], 8) == v)
        elif kind == 3:
            bits = rng.randint(1, 12)
            v = rng.randrange(1 << bits)
            enc.raw_number(v, bits)
            steps.append(lambda d, v=v, b=bits: d.raw_number(b) == v)
        elif kind == 4:
            total = rng.randint(1, 1 << rng.randint(1, 28))
            v = rng.randrange(total)
            enc.uniform(v, total)
            steps.append(lambda d, v=v, t=total: d.uniform(t) == v)
        elif kind == 5:
            centre, decay = rng.randint(1000, 20000), rng.randint(3000, 11456)
            v = e.encode_laplace(enc, int(rng.gauss(0, 6)), centre, decay)
            steps.append(lambda d, v=v, c=centre, y=decay: e.decode_laplace(d, c, y) == v)
        else:
            v = e.pulse_vector(rng.randrange(e.pulse_vectors(6, 5)), 6, 5)
            e.encode_pulses(enc, v)
            steps.append(lambda d, v=v: e.decode_pulses(d, 6, 5) == v)
        steps.append((enc.range, enc.tell(), enc.tell_eighths()))
        if enc.tell() > 8 * 1240:
            break
    dec = e.Decoder(enc.finish())
    for check, state in zip(steps[::2], steps[1::2], strict=True):
        assert check(dec)
        assert (dec.range, dec.tell(), dec.tell_eighths()) == state


def test_budget_and_short_input():
    enc = e.Encoder(2)
    for _ in range(10):
        enc.uniform(200, 256)
    with pytest.raises(e.BudgetError):
        enc.finish()
    dec = e.Decoder(b"")
    assert all(0 <= dec.uniform(100) < 100 for _ in range(50))
