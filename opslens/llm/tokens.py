"""Token ids of many texts through a tokenizer of the tokenizers library, word by word.

For vocabularies whose tokens never cross ASCII white space the ids of a text are the ids of its
white-space-separated chunks, one after another. Each task splits its texts with Arrow, numbers the different
chunks, has the library encode those it has not met yet, and puts the ids together with numpy.
Chunks of Latin letters and closing marks, whose normalised form and pre-tokens are plain to see, go to the
library's model as long runs of letters, cut again at the ids that end a word; all others go through the
whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_CHUNKS = 600_000
SLICE_BYTES = 8 << 20
LETTERS = re.compile(r"[a-z]+")
# letters of ASCII and Latin-1 that lower-casing and NFC turn into one letter each, and marks that may follow them
LATIN = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


class ChunkTokenizer:
    """Encodes texts with add_special_tokens=False. The cache of chunks holds CACHE_CHUNKS, then starts anew."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        if spec["model"].get("end_of_word_suffix") != "</w>" or "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError("a lower-casing vocabulary with word ends is needed")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        del spec["normalizer"]
        plain = json.dumps({**spec, "added_tokens": []})
        self.plain, self.latin = Tokenizer.from_str(plain), Tokenizer.from_str(plain)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ids: dict[str, bytes] = {}

    def _words(self, model, words: list[str]) -> None:
        """Learn words that are one pre-token each."""
        if not words:
            return
        runs = [" ".join(words[i:i + 256]) for i in range(0, len(words), 256)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in model.encode_batch_fast(runs, add_special_tokens=False)])
        stop = np.flatnonzero(self.ends[flat]) + 1
        if len(stop) != len(words):
            raise ValueError("the vocabulary does not end every word")
        raw, begin = flat.tobytes(), 0
        for w, end in zip(words, (4 * stop).tolist()):
            self.ids[w] = raw[begin:end]
            begin = end

    def _learn(self, chunks: list[str]) -> None:
        known, split, rest = self.ids, [], []
        plain, latin, marks = {}, {}, {}
        for c in chunks:
            if (m := LATIN.fullmatch(c)) is None:
                rest.append(c)
                continue
            word, mark = m[1], m[2]
            if mark or not c.isascii():
                low = word if c.isascii() else word.lower()
                split.append((c, low, mark))
                if mark and mark not in known:
                    marks[mark] = None
                word = low
            if word not in known:
                (plain if word.isascii() else latin)[word] = None
        self._words(self.plain, list(plain))
        self._words(self.latin, list(latin))
        rest += marks
        for c, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)):
            known[c] = np.array(e.ids, np.uint32).tobytes()
        for c, word, mark in split:
            known[c] = known[word] + known[mark] if mark else known[word]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # the same ids, but for special tokens written in the text
        split = pc.ascii_split_whitespace(texts)
        numbered = pc.dictionary_encode(split.flatten())
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.ids) > CACHE_CHUNKS:
            self.ids.clear()
        found = list(map(self.ids.get, chunks))
        if None in found:
            self._learn([c for c, i in zip(chunks, found) if i is None])
            found = list(map(self.ids.__getitem__, chunks))
        flat = pa.array(found, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset) if len(flat) else np.zeros(1, np.int64)
        ids = np.frombuffer(flat.buffers()[2], np.uint32, int(ends[-1]) // 4) if ends[-1] else np.zeros(0, np.uint32)
        edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()] // 4
        return ids, np.diff(edges)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text, as uint32; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            held += size
            if held >= SLICE_BYTES or i == len(sizes) - 1:
                ids, n = self._slice(texts.slice(begin, i + 1 - begin))
                out += np.split(ids, np.cumsum(n)[:-1])
                begin, held = i + 1, 0
        return out


@cache
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)
