"""Fast whole-text encoding with the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import held, sliced

#: Entries of a worker's table, of parts of at most ``LONGEST`` characters; a table that is full starts anew.
KNOWN, LONGEST = 600_000, 64
#: Rows, by vocabularies of words with ends and of bytes with spaces, and about so many bytes, that are encoded together; new parts of bytes in one call.
ROWS, BYTE_ROWS, CHARACTERS, NEW = 500, 1000, 4_000_000, 30_000
#: Marks a part that has no space before it; also stands between parts that are encoded in one call.
FIRST, BETWEEN = "\0", "\1"
#: What both vocabularies' patterns take as a blank, but for the space and the line end.
BLANKS = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that other tools take for blanks, or that mark parts here: texts with one go to the library whole.
ODD = "\0\1\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"
#: ASCII marks that end many words; after a letter, a run of these is cut from it by both patterns.
TAIL = "!#$%&*,.:;?|"
#: Letters up to here are letters to every Unicode table in use, and so are their lower cases, but for one.
OLD_LETTERS, DOTTED = "\u0250", "\u0130"
_RUN = re.compile(f"([ \\n{BLANKS}]{{2,}}|[\\n{BLANKS}])")
_BLANK = f"[ \\n{BLANKS}]"
#: Parts that marks end, such a part in two, and texts whose parts are not found by cutting at single blanks.
_MARKED = f"[A-Za-z][{TAIL}]+$"
_IN_TWO = f"(?s)^(?P<base>.*[A-Za-z])(?P<marks>[{TAIL}]+)$"
_UNEVEN = f"[{ODD}{BLANKS}]|\n\n| \n|\n |  "


def _array(parts: list[str]) -> pa.Array:
    return pa.array(parts, pa.large_string())


def _one(part: str) -> pa.Scalar:
    return pa.scalar(part, pa.large_string())


def _gather(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the ``which`` runs, in that order, and the runs' sizes; runs lie in ``ids`` up to their ``ends``."""
    n = sizes[which]
    to = np.cumsum(n)
    return ids[np.repeat(ends[which] - to, n) + np.arange(to[-1] if len(to) else 0)], n


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as the library gives them.

    Texts are cut only where the pattern of the vocabulary cuts in any
    surroundings, so that what lies between two cuts has the same ids alone:

    * words with ends (``</w>``): blanks divide words and have no ids, so any
      run of blanks is a cut;
    * bytes with spaces: before a space that another character than a blank
      follows, as that space belongs to the word; and around a run of blanks
      before it, or before its last blank if that is no space.

    Each distinct part is encoded once per worker, new parts in one call whose
    ids are cut again at what stands between them. Parts of bytes with spaces
    stay in Arrow from cut to ids: a group's distinct ones are looked up at once,
    and ids are gathered by number. A text that holds the string
    of a special token, or a character that tools take for a blank differently,
    goes to the library whole. ``special=False`` reads such strings as ordinary
    text. Memory: at most ``KNOWN`` parts of ``LONGEST`` characters, or ``known``,
    and one group of texts.
    """

    def __init__(self, path: str, special: bool = True, known: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = known or KNOWN
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        vocabulary = self.library.get_vocab()
        self.ends = any(t.endswith("</w>") for t in vocabulary)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.uneven = "|".join([_UNEVEN, *map(re.escape, self.specials)])
        #: By id: whether a token ends a word, or begins with the space before one, as the kind of vocabulary shows it.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.ends else t.startswith("\u0120"))]] = True
        self.mark = np.frombuffer(self._plain([BETWEEN if self.ends else "\n"])[0], np.uint32)
        self.known: dict[str, bytes] = {FIRST: b""}
        self._forget()

    def _forget(self) -> None:
        """An empty table of parts of bytes with spaces: names, sizes and the ids in a row."""
        self.names, self.sizes, self.ids = _array([FIRST]), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, np.uint32).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str, n: int, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of the ``n`` texts that ``text`` joins, from one call and cut where ``edge`` ids begin or end a text, or at line ends or marks between, and where each text's begin and end; nothing should these not be found."""
        ids = np.frombuffer(self._plain([text])[0], np.uint32)
        joints = np.flatnonzero(ids == self.mark[0] if edge is None else edge[ids])
        if edge is None:
            begin, end = np.append(0, joints + 1), np.append(joints, len(ids))
        elif self.ends:
            begin, end = np.append(0, joints[:-1] + 1), joints + 1
        else:
            begin, end = joints, np.append(joints[1:], len(ids))
        return (ids, begin, end) if len(begin) == n and not begin[0] and end[-1] == len(ids) else None

    def _joined(self, texts: list[str], text: str, edge: np.ndarray | None = None) -> list[bytes]:
        """Ids of the texts that ``text`` joins, from one call; from a call for each should it not be cut."""
        if (cut := self._cut(text, len(texts), edge)) is None:
            return self._plain(texts)
        ids, begin, end = cut
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * begin).tolist(), (4 * end).tolist(), strict=True)]

    def _coded(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids, from few calls."""
        # one word each: letters that stay letters in lower case
        words = [p for p in parts if p.isalpha() and max(p) < OLD_LETTERS and DOTTED not in p]
        if words:
            yield from zip(words, self._joined(words, " ".join(words), self.edge), strict=True)
        if rest := list(set(parts).difference(words)):
            yield from zip(rest, self._joined(rest, f" {BETWEEN} ".join(rest)), strict=True)

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't in the table. Marks after an ASCII letter are runs of their own to both patterns, so words and marks are learnt apart; of such a part the whole is kept where its word was known before, as rare words rarely come with the same mark again."""
        known, cut, atoms = self.known, {}, set()
        for part in new:
            if not part.isalpha() and (base := part.rstrip(TAIL)) != part and base[-1:].isascii() and base[-1:].isalpha():
                cut[part] = base, part[len(base) :]
                atoms.update(cut[part])
            else:
                atoms.add(part)
        unknown = [a for a in atoms if a not in known]
        found = dict(self._coded(unknown))
        out = {part: found[part] for part in new if part not in cut}
        for part, (base, marks) in cut.items():
            had = base in known
            out[part] = (known[base] if had else found[base]) + (found[marks] if marks in found else known[marks])
            if had and len(part) <= LONGEST:
                found[part] = out[part]
        known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        return out

    def _learn_parts(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of parts of bytes with spaces that aren't in the table, their ids in a row in that order, and how many each has."""
        first = pc.starts_with(new, FIRST)
        alone = pc.or_(pc.equal(new, ""), pc.and_(first, pc.match_substring_regex(new, _BLANK)))
        texts = pc.if_else(first, pc.utf8_slice_codeunits(new, 1), pc.binary_join_element_wise(_one(""), new, _one(" ")))
        order, ids, sizes = [], [], []
        for these, between, edge in ((pc.and_not(first, alone), "\n", None), (pc.invert(pc.or_(first, alone)), "", self.edge), (alone, None, None)):
            kind = texts.filter(these)
            order.append(these.to_numpy(zero_copy_only=False).nonzero()[0])
            for k in range(0, len(kind), NEW):
                some, cut = kind[k : k + NEW], None
                if between is not None:
                    text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), _one(between))[0].as_py()
                    cut = self._cut(text, len(some), edge)
                if cut is None:
                    coded = self._plain(some.to_pylist())
                    ids.append(np.frombuffer(b"".join(coded), np.uint32))
                    sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
                else:
                    every, begin, end = cut
                    ids.append(every if edge is not None else every[every != self.mark[0]])
                    sizes.append(end - begin)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(sizes)

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of bytes with spaces in a row, and how many each has. Marks after an ASCII letter are runs of their own, so words and marks are learnt and kept apart."""
        coded = parts.dictionary_encode()
        marked = pc.match_substring_regex(coded.dictionary, _MARKED)
        cut = pc.extract_regex(coded.dictionary.filter(marked), _IN_TWO)
        words = pc.replace_with_mask(coded.dictionary, marked, pc.struct_field(cut, "base"))
        marks = pc.binary_join_element_wise(_one(FIRST), pc.struct_field(cut, "marks"), _one(""))
        atoms = pa.concat_arrays([words, marks]).dictionary_encode()
        ids, sizes = self.ids, self.sizes
        at = pc.index_in(atoms.dictionary, value_set=self.names)
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if at.null_count:
            lacking = at.is_null().to_numpy(zero_copy_only=False).nonzero()[0]
            order, new_ids, new_sizes = self._learn_parts(atoms.dictionary.take(pa.array(lacking)))
            places[lacking[order]] = len(self.names) + np.arange(len(order))
            ids, sizes = np.append(ids, new_ids), np.append(sizes, new_sizes)
            new = atoms.dictionary.take(pa.array(lacking[order]))
            short = pc.less_equal(pc.utf8_length(new), LONGEST).to_numpy(zero_copy_only=False).nonzero()[0]
            kept_ids, kept = _gather(new_ids, np.cumsum(new_sizes), new_sizes, short)
            self.names, self.ids, self.sizes = pa.concat_arrays([self.names, new.take(pa.array(short))]), np.append(self.ids, kept_ids), np.append(self.sizes, kept)
        # the table's first part, of no ids, follows words without marks
        places, pairs = places[atoms.indices.to_numpy()], np.zeros((len(words), 2), np.int64)
        pairs[:, 0] = places[: len(words)]
        pairs[marked.to_numpy(zero_copy_only=False), 1] = places[len(words) :]
        ids, sizes = _gather(ids, np.cumsum(sizes), sizes, pairs.ravel())
        sizes = sizes.reshape(-1, 2).sum(1)
        return _gather(ids, np.cumsum(sizes), sizes, coded.indices.to_numpy())

    def parts(self, text: str) -> list[str] | None:
        """What a text is cut into, or nothing where it must stay whole."""
        if any(x in text for x in self.specials) or any(x in text for x in (ODD[:6] if text.isascii() else ODD)):
            return None
        return text.split() if self.ends else self._runs(text)

    @staticmethod
    def _runs(text: str) -> list[str]:
        """The parts of a text with runs of blanks: a run stands alone at the end; before a word its last blank goes with the word if it is a space, and stands alone if not."""
        out: list[str] = []
        pieces, first = _RUN.split(text), FIRST
        for k, piece in enumerate(pieces):
            if k % 2 == 0:
                if piece:
                    out += (first + piece).split(" ")
                continue
            head, last = (piece[:-1], piece[-1]) if pieces[k + 1] else (piece, "")
            out += [FIRST + x for x in (head, last.strip(" ")) if x]
            first = "" if last == " " else FIRST
        return out

    def _encode_bytes(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts by a vocabulary of bytes with spaces. Texts with runs of blanks are cut one by one, the others all at once."""
        out: list[bytes] = [b""] * len(texts)
        if len(self.names) > self.most:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        uneven = pc.match_substring_regex(texts, self.uneven).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~uneven).tolist()
        # what comes first has no space before it
        lines = pc.binary_join_element_wise(_one(FIRST), pc.replace_substring(texts.take(pa.array(rows, pa.int64())), "\n", f" {FIRST}\n {FIRST}"), _one(""))
        cut = pc.split_pattern(lines, " ")
        sizes, parts = pc.list_value_length(cut).to_pylist(), [cut.flatten()]
        for k in np.flatnonzero(uneven).tolist():
            text = texts[k].as_py()
            if (found := self.parts(text)) is None:
                out[k] = self._plain([text])[0]
            else:
                rows.append(k)
                sizes.append(len(found))
                parts.append(_array(found))
        ids, n = self._ids_of(pa.concat_arrays(parts))
        # a worker's memory would stay at what its largest group took
        pa.default_memory_pool().release_unused()
        ends = 4 * np.append(0, np.cumsum(n))[np.cumsum([0, *sizes])]
        raw = ids.tobytes()
        for k, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = raw[a:b]
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if not self.ends:
            return self._encode_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        out: list[bytes] = [b""] * len(texts)
        if len(self.known) > self.most:
            self.known = {FIRST: b""}
        get, wait, new = self.known.get, [], set()
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = self.parts(text)
            if parts is None:
                out[k] = self._plain([text])[0]
                continue
            found = list(map(get, parts))
            if None in found:
                lacks = [j for j, f in enumerate(found) if f is None]
                new.update([parts[j] for j in lacks])
                wait.append((k, parts, found, lacks))
            else:
                out[k] = b"".join(found)
        if new:
            learnt = self._learn(new)
            for k, parts, found, lacks in wait:
                for j in lacks:
                    found[j] = learnt[parts[j]]
                out[k] = b"".join(found)
        return out

    def groups(self, batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of batches with all ids of their column ``text`` in a row, ``end`` after each text, and where each text ends."""
        last = np.uint32(end).tobytes()
        for some in sliced(batches, ROWS if self.ends else BYTE_ROWS, CHARACTERS):
            coded = self.encode(some.column("text"))
            ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4 + 1)
            yield some, np.frombuffer(last.join([*coded, b""]), np.uint32), ends


def encoder(path: str, special: bool = True, known: int | None = None) -> Encoder:
    """This process's encoder for a vocabulary file; ``known`` bounds its table where that shares a worker with others."""
    return held(f"encoder of {path}, {special}, {known}", "tool", lambda: Encoder(path, special, known))
