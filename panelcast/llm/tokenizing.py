"""Token ids of whole texts, read off a tokenizer file, in Arrow batches.

Both byte-level and word-end BPE never join characters across a change from
non-blank to blank, so a text equals its chunks (a run of blanks and the run of
other characters behind it) encoded one by one. A batch of texts is cut into
chunks by Arrow kernels, each distinct chunk is encoded once, and the ids are
gathered back. The ids are those of the whole text.

Most chunks are Latin letters with punctuation behind them, which both tokenizers
split in one way. Their parts go to the tokenizer's model as they are; all other
chunks take the way through its normalizer and splitter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Unicode white space, as the tokenizers' own patterns see it, without blank and newline.
RARE_BLANKS = "\\t\\v\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
BLANK = f"[ \\n{RARE_BLANKS}]"
CUT, MARK = "\x00", "\x01"
# A blank, letters that no normal form changes, punctuation that starts no contraction.
PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# What the plain way must give the same ids for as the tokenizer itself, or else it is not taken.
PROBES = ["a", " a", "\na", " word.", "\nword!?", " Été,", " ÿÀß", " x#*$%&|<>", "THE(", " Straße-"]
BATCH_CHARS = 4_000_000
#: Bytes of kept chunks and ids, with about 200 more for what Python adds to each.
KEPT_BYTES = 48_000_000
ENTRY_BYTES = 200


class ChunkEncoder:
    """Encodes string arrays; ``folded`` tokenizers drop blanks and letter case."""

    def __init__(self, path: str, folded: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.folded = folded
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.model = self.tokenizer.model
        self.bytes = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.ends: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.plain = all(t.special for t in added) and all(self._plain(p) == self._whole(p)[0].tobytes() for p in PROBES)
        self.mark = self.tokenizer.encode(f" {MARK}", add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text. Null is empty."""
        if texts.offset:
            texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels misread sliced arrays
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring(texts, CUT)
        if not pc.any(odd).as_py():
            return self._encode(texts)
        # The cut mark itself is in a text: such texts are encoded whole.
        parts = [self._encode(texts.slice(i, 1)) if not odd[i].as_py() else self._whole(texts[i].as_py()) for i in range(len(texts))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int32), np.array([len(ids)], np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.folded:
            texts = pc.ascii_lower(texts)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", f"{CUT} "), "\n", f"{CUT}\n")
        odd = pc.match_substring_regex(texts, f"[{RARE_BLANKS}]|[ \\n][ \\n]")
        if pc.any(odd).as_py():
            slow = pc.replace_substring_regex(pc.filter(texts, odd), f"({BLANK}+)", f"{CUT}\\1")
            cut = pc.replace_with_mask(cut, odd, slow)
        chunks = pc.split_pattern(cut, CUT)
        coded = chunks.flatten().dictionary_encode()
        flat, lengths = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        known = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths)))), pa.array(flat))
        taken = known.take(coded.indices)
        bounds = taken.offsets.to_numpy()[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        ids = taken.flatten().to_numpy()
        return ids, np.diff(bounds)

    def _distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks; those of earlier batches are kept, up to a bound."""
        found = list(map(self.kept.get, chunks))
        missed = [i for i, ids in enumerate(found) if ids is None]
        asked = [chunks[i] for i in missed]
        given = list(map(self.older.get, asked))
        new = [i for i, ids in enumerate(given) if ids is None]
        for i, ids in zip(new, self._encoded([asked[i] for i in new])):
            given[i] = ids
        for i, ids in zip(missed, given):
            found[i] = ids
        if self.held > KEPT_BYTES // 2:
            # what the last batches used stays, what none of them used goes
            self.kept, self.older, self.held = {}, self.kept, 0
        self.kept.update(zip(asked, given))
        self.held += sum(map(len, asked)) + sum(map(len, given)) + ENTRY_BYTES * len(asked)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.int32), lengths

    def _plain(self, chunk: str) -> bytes | None:
        """Ids of a chunk of Latin letters and punctuation as bytes, None for any other chunk."""
        parts = PLAIN.fullmatch(chunk)
        if parts is None:
            return None
        blank, word, end = parts.groups()
        if self.folded:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        if blank == " " and not self.folded:
            word = self.bytes[32] + word
        ids = array("i", [t.id for t in self.model.tokenize(word)]).tobytes()
        if blank == "\n" and not self.folded:
            ids = self._end(blank) + ids
        return ids + self._end(end) if end else ids

    def _end(self, text: str) -> bytes:
        """Ids of a run of punctuation, or of a line's end; short ones are kept, a bounded number of them."""
        ids = self.ends.get(text)
        if ids is None:
            ids = array("i", [t.id for t in self.model.tokenize(text.translate(self.bytes))]).tobytes()
            if len(text) <= 8 and len(self.ends) < 10_000:
                self.ends[text] = ids
        return ids

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as bytes. Chunks led by a blank that are not plain are joined by a mark, encoded in runs and cut at it."""
        out = list(map(self._plain, chunks)) if self.plain else [None] * len(chunks)
        others = [i for i, ids in enumerate(out) if ids is None]
        if self.folded:
            chunks = [f" {c.lstrip(' ')}" for c in chunks]
        joined = [i for i in others if chunks[i][:1] in (" ", "\n") and len(chunks[i]) > 1 and not chunks[i][-1].isspace() and MARK not in chunks[i]]
        size = len(self.mark)
        for low in range(0, len(joined), 200):
            part = joined[low : low + 200]
            text = f" {MARK}".join([chunks[i] for i in part]) + f" {MARK}"
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = (np.flatnonzero(ids == self.mark[-1]) + 1) * 4
            data, start = ids.tobytes(), 0
            for i, end in zip(part, ends.tolist()):
                out[i] = data[start : end - 4 * size]
                start = end
        rest = sorted(set(others).difference(joined))
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.int32).tobytes()
        return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str, folded: bool = False) -> ChunkEncoder:
    """The worker's encoder of a file: tasks that run in one worker share what it keeps."""
    return ChunkEncoder(path, folded)


def text_batches(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Regroups batches so that each holds about ``chars`` characters, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
        start = 0
        for row in np.flatnonzero(np.cumsum(lengths) // chars != np.concatenate(([0], np.cumsum(lengths)[:-1] // chars))):
            held.append(batch.slice(start, row + 1 - start))
            yield _one(held)
            held, size, start = [], 0, row + 1
        if start < len(lengths):
            held.append(batch.slice(start))
            size += int(lengths[start:].sum())
        if size >= chars:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)
    # a worker serves later tasks too: what this one used goes back
    held = []
    pa.default_memory_pool().release_unused()


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
