"""Encoding by distinct words, for tokenizers and texts that allow it; the library itself for the rest."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import tokenizing

#: Distinct words whose ids a worker keeps.
KEPT = 600_000

_loaded: dict = {}


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[ends[i]:ends[i + 1]] for each i of ``at``, joined, and their lengths."""
    starts, lengths = ends[at], ends[at + 1] - ends[at]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], lengths


class WordEncoder:
    """Encodes by the tokenizer, each distinct word once. A place before a single space or around a
    single line break is a token boundary whatever stands beyond (see ``tokenizing``), so ids of a
    text are the joined ids of its words, each with the space before it; so is a place between a
    letter and a full stop or comma that ends a word. Used only for byte-level BPE with its standard
    pattern, and only for texts whose white space is single spaces and line breaks and that hold no
    special string; all others are encoded whole by the tokenizer."""

    #: Other white space; white space that isn't single or stands at an end; special strings; nothing.
    ODD = (
        r"[\t\x{0b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        r"|  | \n|\n |\n\n|<\||^[ \n]|[ \n]\z|^\z"
    )
    #: A full stop or comma that becomes a word of its own, marked in front.
    STOP = (r"(\pL)([.,])( |\n|\z)", r"\1 " "\v" r"\2\3")

    def __init__(self, path: str):
        import json

        self.tokenizer = tokenizing.load(path)
        with open(path) as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.simple = (
            told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True
            and pre.get("add_prefix_space") is False and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
            and all(x["content"].startswith("<|") for x in told.get("added_tokens", ())) and len(line) == 1
        )
        self.line = line[0] if line else 0
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends, self.met = np.empty(0, "<u4"), np.zeros(1, np.int64), np.empty(0, np.uint8)

    def forget(self) -> None:
        """Keep the words that more than one run of texts had, if those are few enough; else none."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > KEPT // 2:
            return self.clear()
        words, known = list(self.place), (self.flat, self.ends)
        self.clear()
        self.place = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.met = np.ones(len(kept), np.uint8)
        self.flat, lengths = _gather(*known, kept)
        self.ends = np.concatenate([[0], np.cumsum(lengths)])

    def learn(self, words: list[str]) -> None:
        """Encode new words, a few hundred a call, one on each line. Words are marked in front:
        line break, carriage return at the start of a text, vertical tab for a sign that follows a word,
        nothing for a space before."""
        pieces = [w[1:] if w[0] in "\n\r\v" else " " + w for w in words]
        runs = [pieces[i : i + 200] for i in range(0, len(pieces), 200)]
        ids = [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(["\n".join(r) for r in runs], add_special_tokens=False)]
        # a line break stays in front of each word, and goes where the word has none
        flat = np.concatenate([np.concatenate([[self.line], x]) for x in ids]).astype("<u4")
        starts = np.flatnonzero(flat == self.line)
        if len(starts) != len(words):
            raise ValueError("words must not hold line breaks")
        keep = np.ones(len(flat), bool)
        keep[starts[[w[0] != "\n" for w in words]]] = False
        lengths = np.add.reduceat(keep, starts)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, flat[keep]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.uint8)])

    def whole(self, text: str, chunk: int, overlap: int) -> np.ndarray:
        if len(text) <= chunk:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return tokenizing.encode_spliced(self.tokenizer, text, chunk, overlap).astype("<u4")

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        stops = pc.replace_substring_regex(texts, *self.STOP)
        marked = pc.binary_join_element_wise("\r", pc.replace_substring(stops, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        if len(self.place) > KEPT:
            self.forget()
        distinct = words.dictionary.to_pylist()
        # one lookup a word; new ones are learned in their order, so their places are known
        places = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = np.arange(len(self.place), len(self.place) + len(new))
            self.learn([distinct[i] for i in new.tolist()])
        self.met[places] = np.minimum(self.met[places] + 1, 2)
        ids, lengths = _gather(self.flat, self.ends, places[words.indices.to_numpy()])
        return ids, np.add.reduceat(lengths, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())

    def encode(self, texts: pa.Array, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False) if self.simple else np.ones(len(texts), bool)
        ids, n = self.plain(texts.filter(pa.array(~odd))) if not odd.all() else (np.empty(0, "<u4"), np.empty(0, np.int64))
        if not odd.any():
            return ids, n
        cut, parts, k = np.concatenate([[0], np.cumsum(n)]), [], 0
        for is_odd, t in zip(odd.tolist(), texts, strict=True):
            parts.append(self.whole(t.as_py(), chunk, overlap) if is_odd else ids[cut[k] : cut[k + 1]])
            k += not is_odd
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def load(path: str) -> WordEncoder:
    """The worker's encoder of that file, with the words it has met."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
