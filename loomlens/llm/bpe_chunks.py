"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts each text into chunks, so passages that documents share give
the same chunks wherever they stand. A worker encodes each chunk's inner part, between its first and its last
white space, once and keeps the ids for later documents (in bounded stores; what is pushed out is only encoded
again). Fresh inner parts go to the library by their distinct words, all chunks of a batch in one call: it takes
about 1 MB of text a second, and most words come again and again. Cuts fall anywhere, also inside words: at each
join the run between white space that straddles the cut is put together and encoded anew. Every join is then
checked: the run with the whole words on its sides, encoded together, must agree with what stands there. Where it
doesn't, the text is encoded again as a whole.

This holds for tokenizers in which white space only separates words and tokens decode one by one; others are
refused. Letters are folded to lower case beforehand only where the tokenizer's own normalizer does so.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.llm.common import slices

_SPACES = b" \t\n\x0b\x0c\r"
_HEAD = re.compile(rb"[^ \t\n\x0b\x0c\r]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_points(data: np.ndarray, mean_bytes: int, window: int = 8) -> np.ndarray:
    """Offsets at which to cut: where a rolling hash of the last `window` bytes is 0 modulo
    mean_bytes and a new code point starts. They depend on nearby bytes alone."""
    if len(data) <= window:
        return np.zeros(0, np.int64)
    value, rolled = data.astype(np.uint32), np.zeros(len(data) - window, np.uint32)
    for k in range(window):
        rolled = rolled * np.uint32(0x01000193) + value[k : k + len(rolled)]
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    return np.flatnonzero(((rolled >> np.uint32(8)) % np.uint32(mean_bytes) == 0) & ((data[window:] & 0xC0) != 0x80)) + window


#: A full stop or comma by itself after an ASCII letter: a token of its own with or without a space, where this
#: fixed pattern splits words.
_SEAM = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \t\n\x0b\x0c\r])")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalizers that treat A-Z alike whether or not they are in lower case already.
_CASELESS = {"Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents", "Strip"}


class ChunkEncoder:
    """Encodes texts as tokenizer.encode(text, add_special_tokens=False) does, and decodes them.

    Words are kept in two generations: a full store becomes the old one, and what is used again moves
    on from it. Full stores of chunks and of checked joins are emptied.
    """

    def __init__(self, tokenizer_path: str, mean_bytes: int = 1024, word_store: int = 250_000, chunk_bytes: int = 32_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._refuse_others(tokenizer_path)
        self.lowers, self.seams = self._folds()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.number = [str(i) for i in range(size)]
        self.token = [self.tokenizer.decode([i], skip_special_tokens=False) for i in range(size)]
        # A special token between words: the library encodes what is on its sides by itself.
        self.special = next(iter(self.tokenizer.get_added_tokens_decoder().items()), None)
        self.mean_bytes, self.word_store, self.chunk_bytes = mean_bytes, word_store, chunk_bytes
        self.words: dict[bytes, tuple[int, str, str]] = {}
        self.old_words: dict[bytes, tuple[int, str, str]] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.sound: set[tuple[bytes, bytes, bytes]] = set()
        self.kept_bytes = self.encoded_bytes = 0

    def _refuse_others(self, path: str) -> None:
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for gap in [*_SPACES.decode(), *[a + b for a in _SPACES.decode() for b in _SPACES.decode()]]:
            if ids(f"Two{gap}words.") != ids("Two") + ids("words.") or ids(f"{gap}Two{gap}") != ids("Two"):
                raise ValueError(f"{path}: white space is part of tokens; texts can't be cut at it")
        apart = ids("Uncommonest cuttlefish, again")
        if self.tokenizer.decode(apart, skip_special_tokens=False) != " ".join(self.tokenizer.decode([i], skip_special_tokens=False) for i in apart):
            raise ValueError(f"{path}: tokens don't decode one by one")

    def _folds(self) -> tuple[bool, bool]:
        """Whether A-Z may be put in lower case first, and whether a space may be put before single marks."""
        own = json.loads(self.tokenizer.to_str())
        steps = [s for n in [own["normalizer"]] if n for s in n.get("normalizers", [n])]
        lowers = any(s["type"] == "Lowercase" for s in steps) and all(s["type"] in _CASELESS or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
        splits = [s for n in [own["pre_tokenizer"]] if n for s in n.get("pretokenizers", [n])]
        return lowers, bool(splits) and splits[0].get("pattern") == {"Regex": _SPLIT}

    def folded(self, text: bytes) -> bytes:
        """The text with the same encoding in which more words are alike. Texts in which a special token might
        stand are left as they are."""
        if b"<" in text:
            return text
        text = text.lower() if self.lowers else text
        return _SEAM.sub(rb" \1", text) if self.seams else text

    def _known(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.number[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def _encode(self, runs: list[bytes], together: int = 500) -> list[tuple[int, str, str]]:
        self.encoded_bytes += sum(map(len, runs))
        if self.special is None:
            return [self._known(e.ids) for e in self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)]
        mark, text = self.special[0], self.special[1].content
        apart = f" {text} ".encode()
        begins = text[:2].encode()
        groups = [runs[i : i + together] for i in range(0, len(runs), together)]
        joined = [apart.join(r if begins not in r else b"" for r in g).decode() for g in groups]
        found: list[tuple[int, str, str]] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = e.ids
            ends = [*np.flatnonzero(np.asarray(ids, np.int64) == mark).tolist(), len(ids)]
            start = 0
            for run, end in zip(group, ends, strict=True):
                own = ids[start:end] if begins not in run else self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
                found.append(self._known(own))
                start = end + 1
        return found

    def _learn(self, runs: set[bytes]) -> None:
        if len(self.words) > self.word_store:
            self.old_words, self.words = self.words, {}
        missing = [r for r in runs if r not in self.words]
        self.words.update((r, self.old_words[r]) for r in missing if r in self.old_words)
        fresh = [r for r in missing if r not in self.words]
        self.words.update(zip(fresh, self._encode(fresh), strict=True))

    def _inner(self, parts: list[bytes]) -> list[tuple[int, str, str]]:
        """What each part, whole words between white space, is encoded to."""
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(parts, pa.string())))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        self._learn(set(distinct))
        known = [self.words[w] for w in distinct]
        counts, at = np.array([k[0] for k in known], np.int64), words.indices.to_numpy(zero_copy_only=False)
        full = counts[at] > 0
        ends = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]
        at = at[full]
        sums = np.concatenate([[0], np.cumsum(counts[at])])[ends]
        texts = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k[i] for k in known], pa.string()).take(pa.array(at))), " ").to_pylist() for i in (1, 2)]
        return list(zip(np.diff(sums).tolist(), *texts, strict=True))

    def encode_all(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """(number of ids, the ids in decimal joined by a space, the decoded text) of each text."""
        pieces: list[list[bytes]] = []
        for text in map(self.folded, texts):
            cuts = cut_points(np.frombuffer(text, np.uint8), self.mean_bytes).tolist()
            pieces.append([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        if self.kept_bytes > self.chunk_bytes:
            self.chunks, self.kept_bytes = {}, 0
        fresh = [p for p in {p for ps in pieces for p in ps} if p not in self.chunks]
        ends = [(_HEAD.match(p).end(), 1 + max(p.rfind(c) for c in _SPACES)) for p in fresh]
        inner = [p[a:b] for p, (a, b) in zip(fresh, ends, strict=True)]
        for p, (a, b), middle, found in zip(fresh, ends, inner, self._inner(inner), strict=True):
            words = middle.split(None, 1)[:1] + middle.rsplit(None, 1)[-1:] if a < b else []
            first, last = (words[0].strip(), words[1].strip()) if len(words) == 2 else (b"", b"")
            self.chunks[p] = (p[:a], *found, p[b:] if a < b else b"", a < b, first, last)
            self.kept_bytes += 4 * len(p)
        laid = [self._lay(ps) for ps in pieces]
        joins = {join for _, own in laid for join in own}
        if len(self.sound) > self.word_store:
            self.sound = set()
        unseen = list(joins - self.sound)
        self._learn({run for parts, _ in laid for run in parts if type(run) is bytes} | {word for join in unseen for word in join if word})
        torn = self._torn(unseen)
        self.sound.update(j for j in unseen if j not in torn)
        found = [self._join(parts) for parts, _ in laid]
        if torn:
            again = [i for i, (_, own) in enumerate(laid) if not torn.isdisjoint(own)]
            for i, ids in zip(again, self.tokenizer.encode_batch_fast([texts[i].decode() for i in again], add_special_tokens=False), strict=True):
                found[i] = self._known(ids.ids)
        return found

    def _lay(self, pieces: list[bytes]) -> tuple[list, list[tuple[bytes, bytes, bytes]]]:
        """The encoded inner parts of the chunks in order with the runs at the joins between them; and
        each run with the whole words before and after it."""
        parts: list = []
        joins: list[tuple[bytes, bytes, bytes]] = []
        run = last = b""
        for p in pieces:
            head, n, ids, decoded, tail, spaced, first_word, last_word = self.chunks[p]
            run += head
            if spaced:
                if run:
                    parts.append(run)
                    joins.append((last, run, first_word))
                    last = run
                elif last and first_word:  # the cut stood in white space: the words on its sides meet
                    joins.append((last, first_word, b""))
                if n:
                    parts.append((n, ids, decoded))
                    last = last_word
                run = tail
        if run:
            parts.append(run)
            joins.append((last, run, b""))
        return parts, joins

    def _torn(self, joins: list[tuple[bytes, bytes, bytes]]) -> set[tuple[bytes, bytes, bytes]]:
        """The joins whose words, encoded together, don't agree with their own encodings."""
        together = self._encode([b" ".join(filter(None, j)) for j in joins])
        return {j for j, (_, ids, _) in zip(joins, together, strict=True) if ids != " ".join(filter(None, [self.words[w][1] for w in j if w]))}

    def _join(self, parts: list) -> tuple[int, str, str]:
        found = [x for x in [self.words[p] if type(p) is bytes else p for p in parts] if x[0]]
        if not found:
            return 0, "", ""
        counts, ids, decoded = zip(*found, strict=True)
        return sum(counts), " ".join(ids), " ".join(decoded)


@lru_cache(maxsize=1)
def _encoder(path: str, mean_bytes: int) -> ChunkEncoder:
    """A worker's encoder, which outlasts its tasks."""
    return ChunkEncoder(path, mean_bytes)


def encode_documents(docs: DataFrame, *, tokenizer_path: str | None = None, mean_bytes: int = 1024, carry: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """The carried columns, n_tokens, ids_sha256 and decoded_sha256 of each row of docs.

    With texts, also ids (the ids in decimal, joined by a space) and decoded. A null text counts as
    empty: no ids, and digests of empty strings. Long texts are cut like any other, some 4 MB of text at a
    time, a longer text alone. Repeated rows repeat (side by side they are encoded once); an empty table gives no
    rows; other columns of docs don't matter. A narrow map: nothing is shuffled.
    """
    path = tokenizer_path or default_tokenizer()
    own = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    fields = [f for f in own.schema if f.name != "_text"]
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, mean_bytes)
        for whole in batches:
            for batch in slices(whole, ("_text",), 4_000_000, 4_000):
                texts_of = batch.column("_text").to_pylist()
                distinct = list(dict.fromkeys(texts_of))  # a document taken twice stands twice in a row
                known = dict(zip(distinct, encoder.encode_all(distinct), strict=True))
                found = [known[t] for t in texts_of]
                columns = [batch.column(f.name) for f in fields]
                columns += [pa.array([x[0] for x in found], pa.int64())]
                columns += [pa.array([hashlib.sha256(x[i].encode()).hexdigest() for x in found], pa.string()) for i in (1, 2)]
                columns += [pa.array([x[i] for x in found], pa.string()) for i in (1, 2)] if texts else []
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + [x.split()[0] for x in more.split(", ")])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [more])
    found = own.mapInArrow(run, schema)
    return found.select(*[F.col(f"`c_{c}`").alias(c) for c in carry], *[x.split()[0] for x in more.split(", ")])
