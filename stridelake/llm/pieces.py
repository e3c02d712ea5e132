"""SentencePiece ids, byte spans of pieces in the source, and the text decoded from ids.

Encoding is in three steps.  ``Normalizer`` replaces, at each place, the longest prefix that the model's compiled
character map knows, and records for every byte it writes which source bytes it stands for.  The model's merges then
run on the normalised text (the library, on a copy of the model whose own normaliser does nothing).  A piece's length
in normalised bytes, summed along the text, gives its range there, and the record gives its range in the source.

Null text counts as empty: no ids, no spans, empty decoded text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame

#: Characters of text whose pieces are in memory together.
TOGETHER = 1 << 20
SPACE = "▁"  # fixed value: the library's mark for a space


def character_map(compiled: bytes) -> dict[str, str]:
    """Entries of a compiled map: a double-array trie of prefixes, then its zero-ended replacements."""
    if not compiled:
        return {}
    size = struct.unpack_from("<I", compiled)[0]
    units = np.frombuffer(compiled, "<u4", size // 4, 4)
    texts = compiled[4 + size :]
    found, todo = {}, [(0, b"")]
    while todo:  # fixed layout of a unit: offset from bit 10 (shifted by 8 where bit 9 is set), leaf mark in bit 8, label in bits 0-7
        node, prefix = todo.pop()
        unit = int(units[node])
        base = node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))
        if unit >> 8 & 1:
            at = int(units[base]) & 0x7FFFFFFF
            found[prefix.decode("utf-8", "surrogateescape")] = texts[at : texts.index(b"\0", at)].decode()
        for label in range(1, 256):
            child = base ^ label
            if child < len(units) and int(units[child]) & 0x800000FF == label:
                todo.append((child, prefix + bytes([label])))
    return found


class Normalizer:
    """``(text) -> (normalised text, source byte of every normalised byte and of its end)``."""

    def __init__(self, prefixes: dict[str, str], dummy_prefix: bool, squeeze_spaces: bool):
        self.prefixes, self.dummy_prefix, self.squeeze_spaces = prefixes, dummy_prefix, squeeze_spaces
        self.longest: dict[str, int] = {}
        for key in prefixes:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        # Places where some prefix may begin; most text has none.
        self.begins = re.compile(f"[{''.join(map(re.escape, sorted(self.longest)))}]") if prefixes else None

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        out, source = self._mapped(text)
        if self.squeeze_spaces:
            out, source = self._squeezed(out, source)
        raw = np.frombuffer(out.encode(), np.uint8)
        marked = out.replace(" ", SPACE)
        # A space becomes three bytes, all from the byte of the space.
        source = np.repeat(source, np.append(np.where(raw == 0x20, 3, 1), 1)) if " " in out else source
        if self.dummy_prefix and out:
            marked, source = SPACE + marked, np.concatenate([np.repeat(source[:1], 3), source])
        return marked, source

    def _prefix(self, text: str, i: int) -> str | None:
        """The longest known prefix at a place."""
        for length in range(self.longest[text[i]], 0, -1):
            if text[i : i + length] in self.prefixes:
                return text[i : i + length]
        return None

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        if self.begins is None or not self.begins.search(text):
            return text, np.arange(len(text.encode()) + 1)
        parts, source, at, done = [], [], 0, 0
        for match in self.begins.finditer(text):
            if match.start() < done or (old := self._prefix(text, match.start())) is None:
                continue
            plain, new = text[done : match.start()], self.prefixes[old]
            n = len(plain.encode())
            parts += [plain, new]
            source += [np.arange(at, at + n), np.full(len(new.encode()), at + n)]
            at, done = at + n + len(old.encode()), match.start() + len(old)
        n = len(text[done:].encode())
        return "".join([*parts, text[done:]]), np.concatenate([*source, np.arange(at, at + n + 1)])

    def _squeezed(self, out: str, source: np.ndarray) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(out.encode(), np.uint8)
        blank = raw == 0x20
        keep = ~blank | np.append(True, ~blank[:-1])
        solid = np.flatnonzero(~blank)
        if not len(solid):
            return "", source[-1:]
        keep[: solid[0]] = False
        keep[solid[-1] + 1 :] = False
        return raw[keep].tobytes().decode(), np.append(source[:-1][keep], source[solid[-1] + 1])


class PieceEncoder:
    """Ids and source spans of texts by a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            raw = file.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(raw)
        spec = model.normalizer_spec
        if not spec.escape_whitespaces:
            raise ValueError("models that keep plain spaces are not supported")
        self.normalizer = Normalizer(character_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = type(model).SentencePiece
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces])
        self.unknown = self.library.unk_id()

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the first and the end source byte of each piece."""
        normal, source = self.normalizer(text)
        ids = self.merges.encode(normal)
        known = np.asarray(ids, np.int64)
        if (known == self.unknown).any():  # without byte pieces, an unknown piece is as long as the library says
            ends = np.cumsum([len(p.surface.encode()) for p in self.merges.encode(normal, return_type="proto").pieces])
        else:
            ends = np.cumsum(self.lengths[known])
        if len(ends) and ends[-1] != len(source) - 1:
            raise ValueError("pieces do not add up to the text")
        first = source[ends - self.lengths[known]] if not (known == self.unknown).any() else source[np.append(0, ends[:-1])]
        return ids, first, source[ends]


_PIECES = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
                        T.StructField("ends", T.ArrayType(T.IntegerType()))])
_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                        T.StructField("covered_bytes", T.LongType())])


def encode_pieces(text: Column | str, model: str) -> Column:
    """A struct of ``ids``, ``starts`` and ``ends`` (source byte range of each piece) of whole texts."""

    @F.arrow_udf(_PIECES)
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = PieceEncoder(model)
        for column in columns:
            made = [encoder.encode(text.as_py() or "") for text in column]
            lists = [pa.array([x[i] for x in made], pa.list_(pa.int32())) for i in range(3)]
            yield pa.StructArray.from_arrays(lists, names=["ids", "starts", "ends"])

    return encode(F.col(text) if isinstance(text, str) else text)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``doc_id, text``: doc_id, ids, starts, ends, n_tokens and the text decoded from the ids.

    Encoding and decoding in one pass, some texts at a time, so a task holds the numbers of few documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model)
        for batch in batches:
            made, characters = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or ""
                ids, starts, ends = encoder.encode(text)
                made.append((doc_id.as_py(), np.asarray(ids, np.int32), starts.astype(np.int32), ends.astype(np.int32), encoder.library.decode(ids)))
                characters += len(text)
                if characters >= TOGETHER:
                    yield _rows(made)
                    made, characters = [], 0
            if made:
                yield _rows(made)

    def _rows(made: list[tuple]) -> pa.RecordBatch:
        ids, numbers, decoded = [m[0] for m in made], [[m[k] for m in made] for k in (1, 2, 3)], [m[4] for m in made]
        offsets = pa.array(np.cumsum([0, *map(len, numbers[0])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(n))) for n in numbers]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists, pa.array([len(n) for n in numbers[0]], pa.int64()), pa.array(decoded, pa.string())],
                                          names=["doc_id", "ids", "starts", "ends", "n_tokens", "decoded"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, n_tokens long, decoded string")


def decode_pieces(ids: Column | str, model: str) -> Column:
    """Texts of id arrays by the library's decoder; null gives an empty text."""

    @F.arrow_udf(T.StringType())
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for column in columns:
            yield pa.array([library.decode(row.as_py() or []) for row in column], pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def piece_digest(text: Column | str, model: str) -> Column:
    """Encode and decode in one pass: a struct of n_tokens, ids_sha256, decoded_sha256 and covered_bytes.

    ``covered_bytes`` counts source bytes inside some piece's span; it equals the text's length in bytes.
    """

    @F.arrow_udf(_DIGEST)
    def digest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = PieceEncoder(model)
        for column in columns:
            rows = []
            for text in column:
                ids, starts, ends = encoder.encode(text.as_py() or "")
                decoded = encoder.library.decode(ids)
                covered = int(np.maximum(ends - np.maximum(starts, np.append(0, np.maximum.accumulate(ends)[:-1])), 0).sum()) if ids else 0
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_DIGEST.names)

    return digest(F.col(text) if isinstance(text, str) else text)
