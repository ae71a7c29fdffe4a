"""The side-by-side decoder against one that reads a file bit by bit, as the standard puts it."""

import numpy as np
import pytest

from quirelight.llm import pjpeg


class Bits:
    def __init__(self, data):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def bit(self):
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def bits(self, n):
        v = 0
        for _ in range(n):
            v = v * 2 + self.bit()
        return v

    def symbol(self, table):
        code = n = 0
        while (n, code) not in table:
            code, n = code * 2 + self.bit(), n + 1
        return table[n, code]


def huffman(spec):
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for s in spec[at : at + spec[n - 1]]:
            out[n, code] = s
            code += 1
        at += spec[n - 1]
        code *= 2
    return out


def slowly(data):
    import re

    image = pjpeg.Image(data)
    coef = np.zeros((image.blocks, 64), int)
    value = lambda x, s: x if s and x >> (s - 1) else x - (1 << s) + 1
    for comps, ss, se, ah, al, specs, restart, raw in image.scans:
        tables = {c: huffman(s) if s else None for c, s in zip(comps, specs)}
        if len(comps) > 1:
            order, comp = pjpeg.interleaved(image.columns, image.rows, image.sampling)
            per = len(order) // (image.columns * image.rows)
        else:
            order = pjpeg._own_blocks(image.sampling, comps[0], image.columns, image.rows, image.width, image.height)
            comp, per = [comps[0]] * len(order), 1
        step = (restart or len(order)) * per
        for i, piece in enumerate(re.split(rb"\xff[\xd0-\xd7]", raw)):
            b, pred, run = Bits(piece), [0] * 4, 0
            for block, c in zip(order[i * step : (i + 1) * step], comp[i * step : (i + 1) * step]):
                x = coef[block]
                if ss == 0 and not ah:
                    s = b.symbol(tables[c])
                    pred[c] += value(b.bits(s), s) if s else 0
                    x[0] = pred[c] << al
                elif ss == 0:
                    x[0] |= b.bit() << al
                elif not ah:
                    k = ss
                    while k <= se and not run:
                        r, s = divmod(b.symbol(tables[c]), 16)
                        if s:
                            k += r
                            x[k] = value(b.bits(s), s) << al
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            run = (1 << r) + b.bits(r)
                    run = max(0, run - 1)
                else:
                    k = ss
                    while k <= se:
                        new, r = 0, 64
                        if not run:
                            r, s = divmod(b.symbol(tables[c]), 16)
                            if s:
                                new = (1 if b.bit() else -1) << al
                            elif r < 15:
                                run, r = (1 << r) + b.bits(r), 64
                        while k <= se:
                            if x[k]:
                                if b.bit():
                                    x[k] += np.sign(x[k]) << al
                            elif r == 0:
                                x[k] = new
                                k += 1
                                break
                            else:
                                r -= 1
                            k += 1
                    run = max(0, run - 1)
    return coef


def payloads():
    rng = np.random.default_rng(3)
    make = lambda values, n: bytes(rng.choice(values, 64 * n).astype(np.uint8))
    plain = [bytes(64), bytes([128]) * 64 * 9, make(range(256), 14), make([127, 128, 129], 40), make([128] * 60 + [129, 127, 200, 3], 70), "Größe é ".encode() * 64, make([128] * 30 + [126, 131], 7)]
    # As coefficients: these bytes less 128, whatever byte stands for each.
    return plain + [pjpeg.BYTE_OF[np.frombuffer(p, np.uint8)].tobytes() for p in plain]


@pytest.mark.parametrize("number", range(7))
def test_against_the_slow_decoder(number):
    p = payloads()[number]
    file = pjpeg.encode_batch([p])[0]
    images, coef, _ = pjpeg.decode_batch([file])
    assert (coef == slowly(file)).all()
    assert pjpeg.stored_payload(images[0], coef) == p


def test_batches_are_alike_and_lossless():
    some = payloads()
    files = pjpeg.encode_batch(some)
    assert files == [pjpeg.encode_batch([p])[0] for p in some]
    images, coef, bases = pjpeg.decode_batch(files)
    for p, i, lo, hi in zip(some, images, bases, bases[1:]):
        assert pjpeg.stored_payload(i, coef[lo:hi]) == p


def test_tensor_is_the_inverse_transform():
    file = pjpeg.encode_batch([payloads()[2]])[0]
    images, coef, bases = pjpeg.decode_batch([file])
    rgb = next(pjpeg.tensors(images, coef, bases))
    image = images[0]
    assert rgb.shape == (image.height, image.width, 3)
    planes, at = [], 0
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, 8**-0.5, 0.5)
    for (rows, columns), (h, v) in zip(image.shapes, image.sampling):
        plane = np.zeros((rows * 8, columns * 8))
        for n in range(rows * columns):
            block = np.zeros(64)
            block[pjpeg.ZIGZAG] = coef[at + n]
            y, z = n // columns * 8, n % columns * 8
            plane[y : y + 8, z : z + 8] = np.clip(basis @ block.reshape(8, 8) @ basis.T + 128, 0, 255)
        at += rows * columns
        planes.append(plane.repeat(2 // v, 0).repeat(2 // h, 1))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    assert np.abs(want - rgb).max() <= 2.6


def test_zigzag_order():
    assert pjpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and pjpeg.ZIGZAG[-3:].tolist() == [55, 62, 63] and sorted(pjpeg.ZIGZAG) == list(range(64))


def test_broken_files():
    file = pjpeg.encode_batch([bytes(64)])[0]
    for bad in (b"", b"\xff\xd8\xff\xd9", file[:200], b"x" + file):
        with pytest.raises((ValueError, IndexError)):
            pjpeg.decode_batch([bad])
