"""Byte-level BPE through distinct pre-token runs.

The pre-tokenizer's pattern always starts a new piece at a space that begins a
run of white space or that stands right before a visible character. Texts are
cut there into runs (a space and what follows it), each distinct run is
encoded once and looked up from then on. Texts in which a cut at every space
would be wrong, or which hold special strings, are encoded whole by the
`tokenizers` library. Where a vocabulary file is plain byte-level BPE whose ids
are its merge ranks, distinct runs go through tiktoken's merge loop, built
from that same file: the ids are equal and it is about three times as fast.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

from .worker import hold

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space inside or at the end of a longer run of white space: not a place to cut.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Characters that every engine of the pattern takes alike, whatever its version of Unicode.
_ALIKE = re.compile("[\\x00-\\u0557\\u2000-\\u2064\\u3041-\\u3096\\u30a1-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]*")
_PIECES = regex.compile(PATTERN)
#: The merge loop's pattern engine gives up on longer runs of white space: they go through the library, with the same ids.
_LONG_SPACE = re.compile(r"\s{10000}")
_LONG_TOKEN = 10_000
#: Runs that are kept per worker; beyond that the table starts anew, so memory stays bounded.
TABLE_ENTRIES = 250_000
#: Runs joined in one call of the library.
_JOINED = 2_000


class RunTable:
    """run -> its number of ids, or their little-endian 32-bit bytes; equal runs are encoded once while the table holds them."""

    def __init__(self, path: str, keep_ids: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.keep_ids = keep_ids
        self.table: dict[str, object] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # A joined call is taken apart at the ids that start with a space.
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.starts_run = np.zeros(size, bool)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.starts_run[i] = token.startswith("Ġ")
        self.merger = _merger(path)
        # Where all special strings stand for themselves alone, texts are cut at them, the longest first.
        added = self.library.get_added_tokens_decoder().values()
        self.bare = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, text: str) -> list[str]:
        """The text's pre-tokens and special strings; the whole text where the vocabulary isn't one whose cuts are known."""
        special = bool(self.at_special and self.at_special.search(text))
        if not self.merger or (special and not self.bare):
            return [text] if text else []
        if special:
            return [p for part in self.at_special.split(text) for p in ([part] if part in self.special else self.pre_tokens(part))]
        if _ALIKE.fullmatch(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def sizes(self, tokens: list[str]) -> list[int]:
        """The number of ids of each pre-token or special string."""
        merged = [bool(self.merger and len(t) <= _LONG_TOKEN and _ALIKE.fullmatch(t) and not (self.at_special and self.at_special.search(t))) for t in tokens]
        rest = iter(self.whole([t for t, m in zip(tokens, merged, strict=True) if not m]))
        return [len(self.merger.encode_ordinary(t)) if m else next(rest) for t, m in zip(tokens, merged, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        """Of runs, which hold no special string."""
        if self.merger:
            return self.merger.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def kept(self, texts: list[str]) -> list:
        """What the table keeps of texts without special strings."""
        found = map(self.ids, texts)
        return [x.astype("<u4").tobytes() for x in found] if self.keep_ids else [len(x) for x in found]

    def whole(self, texts: list[str]) -> list:
        """The same for any texts, by the library."""
        found = (x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)) if texts else ()
        return [np.array(ids, "<u4").tobytes() for ids in found] if self.keep_ids else [len(ids) for ids in found]

    def plain(self, text: str) -> bool:
        """No special string, no white space at which a cut would be wrong and no very long run of it."""
        return not (_UNSAFE.search(text) or _LONG_SPACE.search(text) or any(s in text for s in self.special))

    def direct(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of whole texts and then `end`, by the merge loop; texts that aren't plain by the library."""
        tail = end.to_bytes(4, "little")
        out = [self.merger.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() + tail if self.plain(t) else b"" for t in texts]
        rest = [i for i, ids in enumerate(out) if not ids]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = ids + tail
        return out

    def runs(self, text: str) -> list[str] | None:
        """The text's runs without their leading space (the first one has none), or None: encode it whole."""
        return text.split(" ") if self.plain(text) else None

    def learn(self, runs: set[str]) -> None:
        """Makes the table hold all of `runs`."""
        new = runs - self.table.keys()
        if len(self.table) + len(new) > TABLE_ENTRIES:
            self.table.clear()
            new = runs
        # Without white space inside, only the first piece of a run starts with a space.
        plain = [r for r in new if r.split() == [r]]
        for at in range(0, len(plain), _JOINED):
            part = plain[at : at + _JOINED]
            ids = self.ids(" " + " ".join(part)).astype("<u4")
            first = np.flatnonzero(self.starts_run[ids])
            if len(first) != len(part) or first[0]:
                continue
            bounds = [*first.tolist(), len(ids)]
            if self.keep_ids:
                raw = ids.tobytes()
                self.table.update((r, raw[4 * a : 4 * b]) for r, a, b in zip(part, bounds, bounds[1:], strict=False))
            else:
                self.table.update(zip(part, map(int.__sub__, bounds[1:], bounds), strict=False))
        rest = [r for r in new if r not in self.table]
        self.table.update(zip(rest, self.kept([" " + r for r in rest]), strict=True))


def _merger(path: str):
    """tiktoken's merge loop for a byte-level BPE file whose ids are its merge ranks; None for any other file."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # The byte alphabet: visible Latin-1 characters stand for themselves, the other bytes for characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(vocab.values()) != list(range(len(vocab))) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    if len(vocab) != 256 + len(pairs) or any(c not in byte_of for t in vocab for c in t):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def run_table(path: str, keep_ids: bool) -> RunTable:
    """This worker's table for a vocabulary file."""
    return hold((path, keep_ids), lambda: RunTable(path, keep_ids))
