"""Operator 2: exact SentencePiece (merge type) encoding by backtracking, and decoding.

A position takes the longest vocabulary match (from an Aho-Corasick automaton) that is compatible with
the token before it; two tokens are compatible when re-merging their joined text gives the same two
tokens back. Where nothing fits, the position is marked in a bitfield as failed and the token before it
is shortened. The result equals merging the whole text by score, without the quadratic merge loop.

Texts are cut where no vocabulary piece can span (a white-space mark after another character, or a
line end outside the vocabulary). What a worker remembers of words, stretches and token pairs is bounded in
bytes. Rows never shuffle: a document is encoded in the task that read it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import table

MARK = "▁"
#: Bytes (about) of one generation of each of a worker's caches, of which it keeps two; longer keys bypass them.
CACHE_BYTES, CACHE_CHARS = 20 << 20, 48
#: What an entry takes besides its key's characters and its tokens, about.
ENTRY_BYTES = 200
_LETTER = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"
#: Characters of text for one result batch.
BATCH_CHARS = 1_000_000


class _Cache(dict):
    """What ``make`` gives for a key. When this generation has ``most`` bytes, it becomes the old one, from which
    keys in use come back."""

    def __init__(self, make, most: int) -> None:
        self._make, self._most, self._old, self._bytes = make, most, {}, 0

    def __missing__(self, key):
        made = self._old.get(key)
        if made is None:
            made = self._make(key)
        size = len(key) if isinstance(key, str) else 0
        if size <= CACHE_CHARS:
            if self._bytes >= self._most:
                self._old, self._bytes = dict(self), 0
                self.clear()
            self[key] = made
            self._bytes += ENTRY_BYTES + 3 * size
        return made


class PieceVocabulary:
    """The pieces of a merge-type model with byte fallback, and the encoder over them.

    The model must be as the query's: identity normalisation, a space mark before the text, white space
    kept. Other settings raise ``ValueError`` instead of giving other results.
    """

    def __init__(self, model: bytes, cache_bytes: int = CACHE_BYTES) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("a model with identity normalisation and a dummy prefix is needed")
        kinds = proto.ModelProto.SentencePiece
        self.text: list[str] = [p.piece if p.type == kinds.NORMAL else "" for p in spec.pieces]
        self.score = [p.score for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)]
        self.end_id = next(i for i, p in enumerate(spec.pieces) if p.piece == "</s>")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.text]
        self.shorter = [self._prefix(t) for t in self.text]
        self.known = frozenset(c for piece in self.ids for c in piece)
        self.pairs = _Cache(self._remerge, cache_bytes)
        alone = {p for p in self.ids if len(p) == 1}
        if not self.known <= alone:
            raise ValueError(f"characters that are in longer pieces only: {sorted(self.known - alone)[:10]}")
        if any(MARK in p.lstrip(MARK) for p in self.ids) or "\n" in self.known:
            raise ValueError("a piece has a space mark inside, or a line end")
        self._cut = re.compile(rf"{MARK}+(?:{_LETTER}+|(?:(?!{_LETTER})[^{MARK}])*)|{_LETTER}+|(?:(?!{_LETTER})[^{MARK}])+")
        if any(len(self._cut.findall(p)) > 1 for p in self.ids):
            self._cut = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")  # pieces mix letters and others
        self.stretches = _Cache(self._encode_stretch, cache_bytes)
        self.words = _Cache(self._encode_word, cache_bytes)

    def _prefix(self, text: str) -> int:
        """The longest piece that is a proper prefix of this one, -1 if none."""
        return next((self.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.ids), -1)

    def merge(self, text: str) -> list[str]:
        """Merges adjacent symbols, best score first and leftmost among equals, until none can."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether re-merging gives the two tokens back; ``left`` -1 asks for the right one alone."""
        return self.pairs[left << 32 | right]

    def _remerge(self, key: int) -> bool:
        tokens = [self.text[i] for i in (key >> 32, key & 0xFFFFFFFF) if i >= 0]
        return self.merge("".join(tokens)) == tokens

    def _encode_known(self, text: str) -> list[int]:
        """Backtracking over a text all of whose characters are pieces."""
        whole = self.ids.get(text)
        if whole is not None and self.compatible(-1, whole):
            return [whole]
        size, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [-1] * size
        for end, i in self.automaton.iter(text):
            start = end - length[i] + 1
            if longest[start] < 0 or length[i] > length[longest[start]]:
                longest[start] = i
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                if open_at[at + length[token]] and pairs[last << 32 | token]:
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            else:  # nothing fits here: forget the position and shorten the token before it
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _encode_stretch(self, text: str) -> bytes:
        if self.known.issuperset(text):
            return array("i", self._encode_known(text)).tobytes()
        out: list[int] = []
        run = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if run < k:
                    out += self._encode_known(text[run:k])
                out += [self.byte_ids[b] for b in c.encode()]
                run = k + 1
        if run < len(text):
            out += self._encode_known(text[run:])
        return array("i", out).tobytes()

    def _encode_word(self, word: str) -> bytes:
        """Ids (as int32 bytes) of a word without white space before it but for line ends: a space mark
        precedes it in the text, unless it starts with a line end."""
        marked = word if word[:1] == "\n" else MARK + word
        return b"".join(map(self.stretches.__getitem__, self._cut.findall(marked)))

    def runs(self, text: str | None) -> list[bytes]:
        """Ids of a whole text in consecutive runs, each the int32 bytes of some tokens."""
        if not text:
            return []
        spaced = text.replace("\n", " \n")
        if MARK in text or "  " in spaced or text[0] in " \n" or text[-1] == " ":
            return list(map(self.stretches.__getitem__, self._cut.findall(MARK + text.replace(" ", MARK))))
        return list(map(self.words.__getitem__, spaced.split(" ")))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without an end id; none for an empty one."""
        return np.frombuffer(b"".join(self.runs(text)), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control ids give nothing, byte ids that are not UTF-8 give U+FFFD each."""
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._with_broken_bytes(ids)
        return text.removeprefix(MARK).replace(MARK, " ")

    def _with_broken_bytes(self, ids: list[int]) -> str:
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(_utf8(raw))
                raw = bytearray()
            parts.append(self.text[i])
        if raw:
            parts.append(_utf8(raw))
        return "".join(parts)


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[k : k + n]).decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_loaded: dict[tuple[bytes, int], PieceVocabulary] = {}


def _vocabulary(model: bytes, cache_bytes: int) -> PieceVocabulary:
    """One vocabulary, and so one cache, for each worker process."""
    key = model, cache_bytes
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceVocabulary(model, cache_bytes)
    return _loaded[key]


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, cache_bytes: int = CACHE_BYTES
) -> DataFrame:
    """One row per input row: id, ``ids`` (array<int>) and ``decoded`` (the text those ids stand for).

    Null and empty texts have no ids but the end id (if ``add_end``) and decode to an empty text. Texts
    of any length are encoded whole. Rows with equal ids or texts are treated alike and all returned;
    other columns are ignored. The model is a bounded file and is sent with the task. A worker's three caches
    take about twice ``cache_bytes`` each.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of the tasks that this worker ran before
        v = _vocabulary(sent.value, cache_bytes)
        end = np.array([v.end_id] if add_end else [], np.int32).tobytes()
        for batch in batches:
            done = 0
            while done < len(batch):
                offsets, ids, decoded, size, stop = [0], [], [], 0, done
                while stop < len(batch) and size < BATCH_CHARS:
                    text = batch.column(1)[stop].as_py() or ""
                    own = b"".join([*v.runs(text), end])
                    ids.append(own)
                    offsets.append(offsets[-1] + len(own) // 4)
                    decoded.append(v.decode(np.frombuffer(own, np.int32).tolist()))
                    size += len(text)
                    stop += 1
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, stop - done), lists, pa.array(decoded, pa.string())], [id_col, "ids", "decoded"]
                )
                done = stop

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame, id_col: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Lengths and hashes of ``encode_decode``'s rows, and the columns named in ``also``."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *also,
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), default_model()))
