"""SentencePiece encoding and decoding with the byte span of every piece in the original text.

The text is normalised here, not in the library: at each position the longest prefix found in the model's compiled
character map is replaced (a double-array trie over UTF-8 bytes), spaces become the meta symbol, a dummy prefix is put in
front, and the offset of the original byte behind every normalised byte is recorded. The library then segments
the normalised text, and piece lengths walk along the recorded offsets.

Segmentation runs on stretches that no piece can cross (from one run of meta symbols to the next, and line feeds), which gives
the ids of the whole text because merges never reach over such a place; whether that holds is read from the
vocabulary. Stretches are remembered per task, at most ``REMEMBER`` of them.

Defined cases: a null text is an empty one, with no ids and an empty decoding; other columns may be anything; repeated
rows give repeated results. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from branchwise.llm.words import columns_and, map_arrow, quoted

META = "▁"
REMEMBER = 400_000


class CharacterMap:
    """The compiled map of a model: a double-array trie from byte strings to offsets in a block of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.out = blob[4 + size:] if blob else b""

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that starts at ``at``, and its replacement; (0, b"") if there is none."""
        found, units, node = (0, b""), self.units, 0
        if not units:
            return found
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i - at + 1, self.out[start:self.out.index(0, start)])
        return found

    def apply(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the offset of the original byte it comes from."""
        if not self.units:
            return raw, np.arange(len(raw) + 1, dtype=np.int64)
        out, origin, at = [], [], 0
        while at < len(raw):
            n, new = self.longest(raw, at)
            if not n:  # one character as it is
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at:at + n]
                origin.extend(range(at, at + n))
            else:
                origin.extend([at] * len(new))
            out.append(new)
            at += n
        return b"".join(out), np.array([*origin, len(raw)], dtype=np.int64)


class Codec:
    """Encodes as the library does, with spans. ``blob``: the serialised model."""

    def __init__(self, blob: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        self.library = spm.SentencePieceProcessor(model_proto=blob)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if not self.escape or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("needs a model with escaped white space, meta symbols in front of words and byte fallback")
        kinds = [p.type for p in proto.pieces]
        plain = [p.piece for p in proto.pieces if p.type in (1, 4)]
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.segmenter = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.lengths = np.array([1 if k == 6 else len(p.piece.encode()) for k, p in zip(kinds, proto.pieces)], dtype=np.int64)
        crossing = any(re.search(f"[^{META}]{META}", p) for p in plain) or any(k == 4 for k in kinds)
        lines = not any("\n" in p and len(p) > 1 for p in plain)
        self.cut = None if crossing else re.compile(f"\n|{META}+[^{META}\n]*|[^{META}\n]+" if lines else f"{META}*[^{META}]+|{META}+")
        self.known: dict[str, bytes] = {}
        self.names = [str(i) for i in range(len(kinds))]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised text with meta symbols, and the original offset of each of its bytes and of its end."""
        raw, origin = self.map.apply(text.encode())
        if self.squeeze:
            codes = np.frombuffer(raw, np.uint8)
            space = codes == 32
            drop = space & np.concatenate(([True], space[:-1]))
            end = len(raw.rstrip(b" "))
            drop[end:] = True
            raw, origin = codes[~drop].tobytes(), np.concatenate((origin[:-1][~drop], origin[-1:]))
        if not raw:
            return b"", origin[-1:]
        codes = np.frombuffer(raw, np.uint8)
        times = np.where(codes == 32, 3, 1)
        origin = np.concatenate((np.repeat(origin[:-1], times), origin[-1:]))
        raw = raw.replace(b" ", META.encode())
        if self.prefix:
            raw, origin = META.encode() + raw, np.concatenate((origin[:1].repeat(3), origin))
        return raw, origin

    def learn(self, normals: list[str]) -> list[list[str]]:
        """Stretches of normalised texts, after the ids of those not seen before were asked for in one call."""
        cuts = [self.cut.findall(n) for n in normals]
        new = set(chain.from_iterable(cuts)).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = set(chain.from_iterable(cuts))
        order = list(new)
        self.known.update(zip(order, [array("i", ids).tobytes() for ids in self.segmenter.encode(order, num_threads=1)]))
        return cuts

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text: ids, and the start of every piece in the original bytes followed by the end of the text."""
        normal = [self.normalise(t) for t in texts]
        strings = [n.decode() for n, _ in normal]
        if self.cut is None:
            found = (array("i", self.segmenter.encode(s)).tobytes() for s in strings)
        else:
            cuts = self.learn(strings)
            found = (b"".join(map(self.known.__getitem__, c)) for c in cuts)
        for (raw, origin), ids in zip(normal, found):
            ids = np.frombuffer(ids, dtype=np.int32)
            ends = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(self.lengths[ids], out=ends[1:])
            if ends[-1] != len(raw):
                raise ValueError("pieces do not cover the normalised text")
            yield ids, origin[ends]


@lru_cache(maxsize=2)
def codec(blob: bytes) -> Codec:
    return Codec(blob)


def _chunks(values: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Lists of texts of about ``most`` characters, or one longer text."""
    part, size = [], 0
    for v in values:
        if part and size + len(v) > most:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v)
    if part:
        yield part


def encode(docs: DataFrame, model: bytes, text: str = "text", digest: bool = False) -> DataFrame:
    """Encode every text; the other columns stay.

    ``digest`` False: ``ids``, ``spans`` (start in original UTF-8 bytes of each piece, then the end) and ``decoded``. True: ``n_tokens``,
    ``ids_sha256`` (ids in decimal joined by commas) and ``decoded_sha256`` in their place, for results of bounded width.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "spans", "decoded"]
    keep = [c for c in docs.columns if c != text and c not in new]
    kinds = ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, spans array<long>, decoded string")
    schema = columns_and(docs, keep, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        names = tool.names
        for batch in batches:
            rows: list[list] = [[], [], []]
            texts = [v.as_py() or "" for v in batch.column(batch.schema.get_field_index(text))]
            for part in _chunks(texts):
                for ids, starts in tool.encode(part):
                    plain = ids.tolist()
                    decoded = tool.library.decode(plain) if plain else ""
                    if digest:
                        joined = ",".join([names[i] for i in plain])
                        row = (len(plain), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        row = (ids, starts, decoded)
                    for out, v in zip(rows, row):
                        out.append(v)
            types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(v, t) for v, t in zip(rows, types)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *new])

    return map_arrow(docs.select(*[quoted(c) for c in [*keep, text]]), run, schema)
