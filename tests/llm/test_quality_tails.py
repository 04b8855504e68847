import base64
import random

import zstandard

from tessera.llm import quality


def test_every_byte_is_judged(documents):
    prose = " ".join(t for t in documents.values() if t).encode()
    junk = base64.b64encode(random.Random(1).randbytes(4096))[:4096]
    c = zstandard.ZstdCompressor(level=quality.Bands().level)
    for text in (prose[:8192] + junk + junk[:4095], junk + junk[:4095] + prose[:8192]):
        whole, n, bad = quality.ratios(text, quality.Bands(), c)
        assert (n, bad) == (4, 2) and not quality.verdict(len(text), whole, n, bad, quality.Bands())
    assert quality.ratios(prose[:12288], quality.Bands(), c)[1] == 3 and quality.ratios(prose[:2048], quality.Bands(), c)[1] == 0


def test_limits_go_by_length(documents):
    prose = " ".join(t for t in documents.values() if t).encode()
    junk = base64.b64encode(random.Random(1).randbytes(200_000))
    bands = quality.Bands()
    c = zstandard.ZstdCompressor(level=bands.level)
    kept = lambda raw: quality.verdict(len(raw), *quality.ratios(raw, bands, c), bands)
    assert [quality.Bands().chunk_limits(n) and quality.Bands().chunk_limits(n)[0] for n in (2048, 2049, 8192, 8193)] == [None, 1024, 1024, 4096]
    assert kept(prose[:4096]) and not kept(prose[:2048] + junk[:2048])
    # a quarter of junk is borne by a text of 32 kB and not by a long one
    assert len(prose) > 98304 and kept(prose[:24576] + junk[:8192]) and not kept(prose[:98304] + junk[:32800])
