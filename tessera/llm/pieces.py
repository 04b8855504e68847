"""SentencePiece encoding and decoding that keeps the place of every piece in the original bytes.

Normalisation walks the text by the longest prefix that the model's compiled character map knows (a Darts
double-array trie, read from the model file) and records, for every normalised byte, the original byte it came from.
The library then encodes the normalised text, and each piece is projected through that record onto a span of
original bytes.

BPE merges never cross from a non-space symbol to a following space symbol if no piece of the vocabulary has a space
symbol after another symbol. Where the vocabulary has that property (it is checked), and the map is
the identity, a text is encoded in segments of spaces and the symbols up to the next space; segments that recur are looked up
in a bounded cache, which gives the library's ids exactly. Any other model or text goes to the library whole. Decoding
is always the library's, of the ids.

Defined cases: a null text is empty; an empty text has the begin and end ids alone and decodes to nothing; a literal space
symbol decodes to a space; rows that repeat are encoded alike; columns besides the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_list

SPACE = "▁"
#: Bytes of text whose new segments go to the library in one call.
TOGETHER = 1 << 21
#: Segments that a worker remembers; then it forgets all and starts again.
MOST_SEGMENTS = 200_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = message[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, message[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, message[i : i + n]
            i += n


class Normalizer:
    """The normaliser of a serialised model: a character map and what is done about white space."""

    def __init__(self, model: bytes):
        spec = next((v for k, v in fields(model) if k == 3), b"")
        own = dict(fields(spec))
        self.set_map(own.get(2, b""))
        self.dummy_prefix = bool(own.get(3, 1))
        self.remove_extra = bool(own.get(4, 1))
        self.escape = bool(own.get(5, 1))

    def set_map(self, compiled: bytes) -> None:
        self.units, self.target = None, b""
        if compiled:
            (n,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, dtype="<u4", count=n // 4, offset=4).tolist()
            self.target = compiled[4 + n :]

    @property
    def identity(self) -> bool:
        return self.units is None and not self.remove_extra and self.escape

    def longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """Length and value of the longest key of the map that ``raw`` has at ``at``."""
        units = self.units
        node, found = 0, None
        offset = self._offset(units[0])
        for k in range(at, len(raw)):
            node = (offset ^ raw[k]) if k == at else (node ^ raw[k])
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k - at + 1, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def steps(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        """Replacements one after the other and how many original bytes each stands for."""
        i = 0
        while i < len(raw):
            hit = self.longest(raw, i) if self.units else None
            if hit:
                n, value = hit
                yield self.target[value : self.target.index(b"\0", value)], n
            else:
                b = raw[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                yield raw[i : i + n], n
            i += n

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, spaces written as the space symbol, and for each of its bytes, and its end, the original byte."""
        space = SPACE.encode() if self.escape else b" "
        out, place, at = bytearray(), [], 0
        pending = self.remove_extra  # spaces at the start go if extra ones do
        end = 0
        for piece, n in self.steps(raw):
            if self.remove_extra and pending:
                piece = piece.lstrip(b" ")
            if piece:
                if not out and self.dummy_prefix:
                    out += space
                    place += [at] * len(space)
                for c in piece.split(b" ") if b" " not in piece else re.findall(rb" |[^ ]+", piece):
                    if c == b" " and self.remove_extra and pending:
                        continue
                    written = space if c == b" " else c
                    out += written
                    place += [at] * len(written)
                    pending = c == b" "
                end = at + n
            at += n
        if self.remove_extra:
            while out.endswith(space):
                del out[-len(space) :]
                end = place[len(out)]
                del place[len(out) :]
        return bytes(out), np.array([*place, end], dtype=np.int64)


class Encoder:
    """Ids, original byte spans and the decoded text of texts, as the library gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.norm = Normalizer(self.lib.serialized_model_proto())
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        #: Bytes of the normalised text that a piece covers; a byte piece stands for one.
        self.covers = np.array([0 if self.lib.is_control(i) else 1 if self.lib.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], dtype=np.int64)
        self.split = self.norm.identity and self.norm.dummy_prefix and not any(inner.search(p) for p in pieces) and sum(self.lib.is_byte(i) for i in range(n)) == 256 and array("I").itemsize == 4 and sys.byteorder == "little"
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        #: ids by segment, without its first space symbol
        self.cache: dict[str, bytes] = self._lone()
        self.segments = re.compile(" *[^ ]+| +")

    def _lone(self) -> dict[str, bytes]:
        """A lone space symbol, which the library can't be asked for by itself."""
        return {"": array("I", [self.lib.piece_to_id(SPACE)]).tobytes()}

    def _segments(self, text: str) -> list[str] | None:
        """The text behind its leading space symbol, cut before each run of spaces; None if it has to go to the library whole."""
        if not self.split or not text or SPACE in text or "\0" in text:
            return None
        line = " " + text
        if "  " in line or line.endswith(" "):
            return self.segments.findall(line)
        return line.split(" ")[1:]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """For each text all ids but begin and end."""
        cut = [self._segments(t) for t in texts]
        # a segment without its one leading space is what the library is given: it puts that space before it
        cut = [s if s is None or not s[0].startswith(" ") else [x[1:] for x in s] for s in cut]
        wanted = {x for s in cut if s for x in s}
        missing = wanted.difference(self.cache)
        if len(self.cache) + len(missing) > MOST_SEGMENTS:
            self.cache = self._lone()
            missing = wanted.difference(self.cache)
        missing = list(missing)
        self.cache.update(zip(missing, [array("I", ids).tobytes() for ids in self.lib.encode(missing, num_threads=1)] if missing else ()))
        look, out = self.cache.__getitem__, []
        for t, s in zip(texts, cut):
            out.append(np.array(self.lib.encode(t), dtype="<u4") if s is None else np.frombuffer(b"".join(map(look, s)), dtype="<u4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        return self.lib.decode([i.tolist() for i in ids], num_threads=1) if ids else []

    def spans(self, raw: bytes, ids: np.ndarray) -> np.ndarray:
        """Start and end byte in ``raw`` of every piece of ``ids`` (without begin and end)."""
        if self.norm.identity:
            return self._identity_spans(raw, ids)
        normal, place = self.norm.normalize(raw)
        end = np.minimum(np.cumsum(self._covered(ids, normal)), len(normal))
        return np.stack((place[np.concatenate(([0], end[:-1]))] if len(end) else end, place[end]), axis=1)

    def _covered(self, ids: np.ndarray, normal: bytes) -> np.ndarray:
        covers = self.covers[ids]
        unknown = np.flatnonzero(ids == self.lib.unk_id())
        if len(unknown):  # what an unknown piece stands for is known to the library alone
            found = self.lib.encode(normal.decode().replace(SPACE, " ").removeprefix(" " if self.norm.dummy_prefix else ""), return_type="proto")
            covers = np.array([len(p.piece.encode()) for p in found.pieces], dtype=np.int64)
        return covers

    def _identity_spans(self, raw: bytes, ids: np.ndarray) -> np.ndarray:
        """Without a map a space of one byte stands for a symbol of three, and the first for none."""
        if not len(ids):
            return np.zeros((0, 2), dtype=np.int64)
        if SPACE.encode() in raw or self.lib.unk_id() in ids:
            normal, place = self.norm.normalize(raw)
            end = np.minimum(np.cumsum(self._covered(ids, normal)), len(normal))
            return np.stack((place[np.concatenate(([0], end[:-1]))], place[end]), axis=1)
        if not hasattr(self, "plain"):
            self.plain = np.array([c - 2 * self.lib.id_to_piece(i).count(SPACE) if not (self.lib.is_byte(i) or self.lib.is_control(i)) else c for i, c in enumerate(self.covers)], dtype=np.int64)
        end = np.cumsum(self.plain[ids]) - int(self.norm.dummy_prefix)
        end = np.clip(end, 0, len(raw))
        return np.stack((np.concatenate(([0], end[:-1])), end), axis=1)


_ENCODERS: dict[str, Encoder] = {}
LISTS = {"ids": "array<int>", "spans": "array<int>", "decoded": "string"}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", lists: tuple[str, ...] = tuple(LISTS)) -> DataFrame:
    """``key`` and, for its text, ``n_tokens, ids_sha256, decoded_sha256, spans_sha256`` and what ``lists`` names of ``ids`` (begin and end among them), ``spans`` (flat start, end in bytes of the original) and ``decoded``."""
    source = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    schema = f"__id {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    schema += "".join(f", {n} {LISTS[n]}" for n in lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            texts = byte_list(batch.column(1))
            for i, j in blocks(texts, TOGETHER):
                part = batch.slice(i, j - i)
                out: dict[str, list] = {n: [] for n in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "ids", "spans", "decoded")}
                inner = e.encode_all([t.decode() for t in texts[i:j]])
                whole = [np.concatenate(([e.bos], ids, [e.eos])).astype("<u4") for ids in inner]
                for raw, ids, every, decoded in zip(texts[i:j], inner, whole, e.decode_all(whole)):
                    spans = e.spans(raw, ids)
                    out["n_tokens"].append(len(every))
                    out["ids_sha256"].append(hashlib.sha256(every.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    out["spans_sha256"].append(hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest())
                    out["ids"].append(every.astype(np.int32) if "ids" in lists else None)
                    out["spans"].append(spans.astype(np.int32).ravel() if "spans" in lists else None)
                    out["decoded"].append(decoded if "decoded" in lists else None)
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "spans": pa.list_(pa.int32())}
                names = [n for n in out if n not in LISTS] + list(lists)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[n], type=kinds.get(n, pa.string())) for n in names)], names=["__id", *names])

    return source.mapInArrow(run, schema).withColumnRenamed("__id", key)
