"""A word-level BPE vocabulary (tokenizers JSON with an end-of-word suffix), read for three uses:
exact id encoding with forced boundaries, token counting by a compiled transducer, and decoding.

White space never reaches a token of such a vocabulary, so a text is the sequence of its white-space
free *runs*, a run the sequence of its pre-tokens, and each pre-token encodes independently. Single texts
memoise pre-tokens in two bounded generations; batches memoise runs, and those that are new are merged together as
the rows of one matrix.
"""

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from operator import itemgetter

import numpy as np

from .batches import KEPT

#: What the vocabulary's normaliser replaces by one blank. str.split() also cuts at 1C-1F, which it keeps.
RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_SPLIT = re.compile("[\x1c-\x1f]")
#: Characters on which lower-casing and classes are the same in every Unicode version and NFC does nothing.
PLAIN = re.compile("[\t-\r -~\x85\xa0-\xac\xae-\xff]*")
#: The pre-tokeniser's pattern for lower-cased PLAIN text, its letters and numbers spelled out and the commonest first; of pieces
#: that can begin alike, contractions still precede others.
SPLIT = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:[stmd]|re|ve|ll)|[^\s0-9²³¹¼-¾a-zªµºß-öø-ÿ]+")
#: A full stop or comma that is only a part of a piece of marks.
BESIDE = re.compile(r"[^\s0-9²³¹¼-¾a-zªµºß-öø-ÿ](?:[.,]|(?<=[.,])[^\s0-9²³¹¼-¾a-zªµºß-öø-ÿ])")
#: Letters, and marks, that neither compose nor lower-case with their neighbours: three of one sort before a cut and one
#: after it lie in one piece. Digits are pieces of their own.
_LETTER = "A-Za-z\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
INSIDE = re.compile(f"(?<=[{_LETTER}]{{3}})[{_LETTER}]|(?<=[-!\"#$%&()*+,./:;=?@\\[\\]^_`{{}}~]{{3}})[-!\"#$%&()*+,./:;=?@\\[\\]^_`{{}}~]")
NUMBERS = re.compile("(?<=[0-9])[0-9]")
WARM = 48
FINAL = 256
GENERATION = 200_000
AT_ONCE = 100_000
#: Runs that a worker keeps from one batch to the next, and characters of the longest of them.
KNOWN = 150_000
LONG = 64
#: Widths of the matrices whose rows are pieces, in bytes; longer pieces are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 40)
ROWS = 1 << 14
#: Of the table of merges: bits of its slots' numbers, the factor that spreads keys over them, what no key or rank equals.
SLOT_BITS = 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)
NO_KEY = np.uint64((1 << 64) - 1)
NO_RANK = np.int32((1 << 31) - 1)
NO_ID = np.int32((1 << 20) - 1)


def runs(text: str) -> list[str]:
    return RUN.findall(text) if ODD_SPLIT.search(text) else text.split()


def joined(found: dict[str, bytes], pieces: list[str]) -> bytes:
    """The values of ``pieces``, one after another: looked up by a single call, which is faster, unless there are very many."""
    return b"".join(itemgetter(*pieces)(found) if 1 < len(pieces) <= AT_ONCE else map(found.__getitem__, pieces))


class Memo(dict):
    """A map that computes what it lacks and holds at most two generations of GENERATION entries;
    entries used since the last turn survive it."""

    def __init__(self, make, limit: int = GENERATION):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def shrink(self) -> None:
        """Forgets the older generation: a worker that waits for its next task holds less."""
        self.old = {}

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = value

    def put_all(self, made: dict) -> None:
        """All of ``made``, fewer than a generation."""
        if len(self) + len(made) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update((key, value) for key, value in made.items() if len(key) < 64)


def byte_letters() -> dict[str, int]:
    """Letter of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the other
    bytes in order get the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordBpe:
    """Tables of one vocabulary file; see the module's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.path, suffix, vocab = path, model["end_of_word_suffix"], model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.names = {i: w for w, i in (vocab | special).items()}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for word, i in vocab.items():
            if word in special:
                continue
            end = word.endswith(suffix) and len(word) > len(suffix)
            codes = [letters[c] for c in (word[: -len(suffix)] if end else word)]
            self.symbols[i] = (*codes[:-1], codes[-1] + FINAL * end)
        single = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        self.single = [single[s] for s in range(2 * FINAL)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pair_keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.uint64)  # by rank
        self.pair_ids = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        #: inside[x * 512 + y] is 1 if some token holds symbol y right after x; elsewhere a cut is certain.
        self.inside = bytearray((2 * FINAL) ** 2)
        for s in self.symbols.values():
            for x, y in zip(s, s[1:]):
                self.inside[x * 2 * FINAL + y] = 1
        self.library = None
        self.letters = letters
        self.piece_ids = Memo(self.encode_piece)
        self.known = {t: array("I", [i]).tobytes() for t, i in special.items()}

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Of each pair of ids: the rank of its merge, and the merged id."""
        ranked = zip(self.pair_keys.tolist(), enumerate(self.pair_ids.tolist()))
        return dict(reversed(list(ranked)))  # of repeated pairs the first holds

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The same as a hash table: key and rank of each slot; a key lies in the first slot from its own that was free."""
        keys, first = np.unique(self.pair_keys, return_index=True)
        bits = max(SLOT_BITS, len(keys).bit_length() + 2)
        table, ranks = np.full(1 << bits, NO_KEY), np.full(1 << bits, NO_RANK)
        slot = (keys * SPREAD) >> np.uint64(64 - bits)
        while len(keys):
            slot &= np.uint64(len(table) - 1)
            taken, one = np.unique(slot, return_index=True)
            one = one[table[taken] == NO_KEY]
            table[slot[one]], ranks[slot[one]] = keys[one], first[one]
            keys, first, slot = np.delete(keys, one), np.delete(first, one), np.delete(slot, one) + np.uint64(1)
        return table, ranks

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NO_RANK where there's no merge."""
        table, ranks = self.slots
        keys = ((left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)).ravel()
        slot = (keys * SPREAD) >> np.uint64(65 - len(table).bit_length())
        held = table[slot]
        out = ranks[slot]
        other = held != keys
        out[other] = NO_RANK
        rest = np.flatnonzero(other & (held != NO_KEY))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & np.uint64(len(table) - 1)
            held = table[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = ranks[slot[rest[hit]]]
            rest = rest[~hit & (held != NO_KEY)]
        return out.reshape(left.shape)

    # -- from text to byte pieces --------------------------------------------------------------

    def tokenizer(self):
        """The library's tokenizer of this file, single-threaded."""
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, normalised; a special token stands as itself."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return SPLIT.findall(text.lower())
        out: list[str] = []
        for run in runs(text):
            if PLAIN.fullmatch(run) and "<|" not in run:
                out += SPLIT.findall(run.lower())
                continue
            for part in self.cut_special.split(run):
                if part in self.special:
                    out.append(part)
                elif part:
                    part = self.tokenizer().normalizer.normalize_str(part)
                    for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                        out.append(bytes(self.letters[c] for c in mapped).decode())
        return out

    # -- encoding ------------------------------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """BPE of one fragment: the pair of least rank first, the leftmost among equals."""
        if len(ids) > 48:
            return self.merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best = None
            for k in range(len(ids) - 1):
                m = merges.get((ids[k] << 20) | ids[k + 1])
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n, over a linked list and a heap of candidate pairs."""
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k] << 20) | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = merges[(a << 20) | b][1], -1
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for i in (left[k], k):
                if i >= 0 and (e := right[i]) >= 0 and (m := merges.get((ids[i] << 20) | ids[e])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[e]))
        return [x for x in ids if x >= 0]

    def fragments(self, piece: str) -> list[list[int]]:
        """The symbols of a piece, cut wherever a pair of neighbours occurs inside no token."""
        symbols = list(piece.encode())
        symbols[-1] += FINAL
        inside, begin, out = self.inside, 0, []
        for k in range(1, len(symbols)):
            if not inside[symbols[k - 1] * 512 + symbols[k]]:
                out.append(symbols[begin:k])
                begin = k
        out.append(symbols[begin:])
        return out

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        if piece in self.special:
            return array("I", [self.special[piece]]).tobytes()
        out: list[int] = []
        single = self.single
        for fragment in self.fragments(piece):
            out += self.merge([single[x] for x in fragment])
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.piece_ids.__getitem__, self.pieces(text)))

    def words(self, text: str) -> list[str]:
        """What a text is looked up by: the runs of a PLAIN one, lower-cased and parted at full stops and commas that are pieces of
        their own, the pieces of any other. A run that is a piece has its ids, so both can share a table."""
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self.pieces(text)
        text = text.lower()
        return text.split() if BESIDE.search(text) else text.replace(".", " . ").replace(",", " , ").split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The same for a batch: words that aren't known yet are encoded together, and all are known until their texts are
        put together. Then long ones are forgotten, and all but the batch's own if there are more than KNOWN."""
        split = [self.words(t) for t in texts]
        here = set().union(*split)
        known = self.known
        long = self.learn(here.difference(known))
        out = [joined(known, words) for words in split]
        for w in long:
            del known[w]
        if len(known) > KNOWN:
            self.known = {w: known[w] for w in here.union(self.special) if w in known}
        return out

    def learn(self, words: set[str]) -> list[str]:
        """Puts words, and the pieces of compound ones, into the table; those of LONG characters or more are returned."""
        known, pieces, compound = self.known, [], {}
        for w in words:
            if w.isalpha() or not PLAIN.fullmatch(w):
                pieces.append(w)
            elif len(parts := SPLIT.findall(w)) == 1:
                pieces.append(w)
            else:
                compound[w] = parts
        pieces += set().union(*compound.values()).difference(known, words)
        for k in range(0, len(pieces), ROWS):
            self.merge_all(pieces[k : k + ROWS])
        known.update({w: b"".join(map(known.__getitem__, parts)) for w, parts in compound.items()})
        return [w for group in (pieces, compound) for w in group if len(w) >= LONG]

    def merge_all(self, pieces: list[str]) -> None:
        """Puts pieces, which differ, into the table. Each round merges in every row the pair of least rank, the leftmost among
        equals, so all rows lose one id; those without a pair to merge are done."""
        data = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        flat, begins = np.frombuffer(b"".join([*data, bytes(WIDTHS[-1])]), dtype=np.uint8), np.cumsum(sizes) - sizes
        single, least, done = np.array(self.single, dtype=np.int32), 0, []
        for width in WIDTHS:
            at = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if not len(at):
                continue
            places = np.arange(width)
            symbols = flat[begins[at, None] + places].astype(np.int16)
            symbols[np.arange(len(at)), sizes[at] - 1] += FINAL
            ids = np.where(places < sizes[at, None], single[symbols], NO_ID)
            ranks = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(at):
                pair = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(at)), pair]
                going = rank != NO_RANK
                if not going.all():
                    done.append((at[~going], ids[~going]))
                    at, ids, ranks, pair, rank = at[going], ids[going], ranks[going], pair[going], rank[going]
                row, into = np.arange(len(at)), self.pair_ids[rank]
                ids[row, pair] = into
                wide = ids.shape[1] - 1
                ids = ids[np.arange(wide + 1) != pair[:, None] + 1].reshape(-1, wide)
                if wide < 2:
                    done.append((at, ids))
                    break
                ranks = ranks[np.arange(wide) != pair[:, None]].reshape(-1, wide - 1)
                for has, k in ((pair > 0, pair - 1), (pair < wide - 1, pair)):
                    r, k = row[has], k[has]
                    ranks[r, k] = self.ranks(ids[r, k], ids[r, k + 1])
        known = self.known
        known.update((pieces[k], self.encode_piece(pieces[k])) for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist())
        for at, ids in done:
            within = ids != NO_ID
            ends = (4 * np.cumsum(within.sum(axis=1))).tolist()
            joint = ids[within].astype("<u4").tobytes()
            known.update((pieces[k], joint[begin:end]) for k, begin, end in zip(at.tolist(), [0, *ends], ends))

    def decode(self, ids: bytes) -> str:
        """The library's decode() for a vocabulary without decoder: token strings joined by blanks."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One instance for each worker process and file."""
    return WordBpe(path)


class CountTransducer:
    """A deterministic transducer over byte symbols whose transitions carry changes of the token count.

    Let t(p) be the last token of the encoding of the first p symbols of a piece. A token u that ends at p
    is t(p) exactly if u follows t(p - len(u)) as a valid pair, i.e. both stay as they are when their
    concatenation is encoded. So t(p) and the count follow from the longest suffix that begins a token (a
    node of an Aho-Corasick automaton) and from the tokens and relative counts at that suffix's positions.
    Those values are the state: finitely many, since the suffix is no longer than a token. States are
    determinised when first reached and dropped when there are too many of them.
    """

    STATES = 60_000
    BLOCK = 8

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.goto: dict[int, int] = {}
        self.depth, self.token = [0], [-1]
        for i, s in bpe.symbols.items():
            if bpe.merge([bpe.single[x] for x in s]) != [i]:
                continue  # its own symbols encode otherwise: it's never output
            node = 0
            for x in s:
                node_ = self.goto.get(node * 512 + x)
                if node_ is None:
                    node_ = self.goto[node * 512 + x] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = node_
            self.token[node] = i
        self.link()
        self.pairs: dict[int, bool] = {}
        self.pinned = False  # while trails hold numbers of states
        self.reset()
        self.piece_count = Memo(self.count_piece)

    def link(self) -> None:
        """Failure links, and for each node the nearest node on its failure path that ends a token."""
        children: list[list] = [[] for _ in self.depth]
        for key, child in self.goto.items():
            children[key >> 9].append((key & 511, child))
        self.fail, self.ends = [0] * len(self.depth), [0] * len(self.depth)
        layer = [child for _, child in children[0]]
        while layer:
            following = []
            for node in layer:
                f = self.fail[node]
                self.ends[node] = f if self.token[f] >= 0 else self.ends[f]
                for x, child in children[node]:
                    following.append(child)
                    self.fail[child] = self.next_node(f, x)
            layer = following

    def next_node(self, node: int, x: int) -> int:
        while True:
            found = self.goto.get(node * 512 + x)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.fail[node]

    def reset(self) -> None:
        self.known = {(0, -1, 0): 0}
        self.states = [(0, -1, 0)]
        self.step: dict[int, tuple[int, int]] = {}

    def valid(self, a: int, b: int) -> bool:
        key = (a << 20) | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            single = self.bpe.single
            ids = [single[x] for x in self.bpe.symbols[a] + self.bpe.symbols[b]]
            found = self.pairs[key] = self.bpe.merge(ids) == [a, b]
        return found

    def move(self, state: int, x: int) -> tuple[int, int]:
        """The transition from a state on symbol x: the next state, and the change of the count."""
        node, *past = self.states[state]  # past: token and count, less the present count, at each position back
        node = at = self.next_node(node, x)
        if self.token[at] < 0:
            at = self.ends[at]
        while True:
            u = self.token[at]
            back = 2 * (self.depth[at] - 1)
            if back < len(past) and (past[back] < 0 or self.valid(past[back], u)):
                change = past[back + 1] + 1
                break
            at = self.ends[at]
        if x >= FINAL:
            return 0, change
        keep = past[: 2 * self.depth[node]]
        for k in range(1, len(keep), 2):
            keep[k] -= change
        key = (node, u, 0, *keep)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        return to, change

    def count_piece(self, piece: str) -> int:
        if piece in self.bpe.special:
            return 1
        if len(self.states) > self.STATES and not self.pinned:
            self.reset()
        state = count = 0
        step, symbols = self.step, list(piece.encode())
        symbols[-1] += FINAL
        for x in symbols:
            key = (state << 9) | x
            move = step.get(key)
            if move is None:
                move = step[key] = self.move(state, x)
            state = move[0]
            count += move[1]
        return count

    # -- state maps of chunks ------------------------------------------------------------------

    def run(self, state: int, symbols: bytes, end: bool, trail: tuple[array, array] | None = None) -> tuple[int, int]:
        """The state after a piece's bytes, entered in ``state``, and the tokens emitted; ``end``: the piece ends here.
        ``trail`` takes the state and the count after each byte."""
        step, count, last = self.step, 0, len(symbols) - 1 if end else -1
        for k, x in enumerate(symbols):
            key = (state << 9) | (x + FINAL if k == last else x)
            move = step.get(key)
            if move is None:
                move = step[key] = self.move(state, key & 511)
            state = move[0]
            count += move[1]
            if trail is not None:
                trail[0].append(state)
                trail[1].append(count)
        return state, count

    def entered(self, values: tuple) -> int:
        """The number of a state given by its values (they outlive ``reset``)."""
        state = self.known.get(values)
        if state is None:
            state = self.known[values] = len(self.states)
            self.states.append(values)
        return state

    def safe_cut(self, text: str, near: int, least: int) -> tuple[int, bool]:
        """Where to cut a text, at ``near`` or as little before it as can be, but after ``least``; beyond it otherwise. Whether a
        piece is open there. White space and digits part pieces. Between letters (or marks) that neither compose nor lower-case
        with their neighbours a piece stays open, if enough of them precede to be past any contraction."""
        for low, high in ((max(least + 1, near - 4096), near), (near + 1, near + 4096)):
            for part, open_ in ((BLANK, False), (INSIDE, True), (NUMBERS, False)):
                found = list(part.finditer(text, max(low - 8, least), min(high + 1, len(text))))
                for m in reversed(found) if high == near else found:
                    at = m.end() - 1
                    if low <= at <= high and not self.in_special(text, at):
                        return at, open_
        return (self.safe_cut(text, near + 4096, near + 1) if near + 4096 < len(text) else (len(text), False))

    def in_special(self, text: str, at: int) -> bool:
        """Whether a special token's string spans the place."""
        return any(text.find(t, max(0, at - len(t) + 1), at + len(t) - 1) >= 0 for t in self.bpe.special)

    def chunks(self, text: str, chunk_chars: int) -> Iterator[tuple[str, bool, bool]]:
        """A text's chunks, with whether a piece is open at their beginning and at their end."""
        begin, open_ = 0, False
        while len(text) - begin > chunk_chars:
            end, more = self.safe_cut(text, begin + chunk_chars, begin)
            yield text[begin:end], open_, more
            begin, open_ = end, more
        yield text[begin:], open_, False

    def chunk_map(self, chunk: str, open_: bool, more: bool, guess: tuple) -> "ChunkMap":
        """What a chunk does to any entry state; ``guess``: the values of the state that it's probably entered in."""
        pieces = self.bpe.pieces(chunk)
        head = pieces[0].encode() if open_ and pieces else b""
        if len(pieces) == 1 and open_ and more:
            return ChunkMap(self, head, False, 0, None, guess)
        inner = pieces[bool(open_) : len(pieces) - bool(more)]
        tail = self.run(0, pieces[-1].encode(), False) if more and pieces else (0, 0)
        return ChunkMap(self, head, True, sum(map(self.piece_count.__getitem__, inner)) + tail[1], self.states[tail[0]], guess)

    def scan(self, maps: list) -> list:
        """Inclusive prefix composition in a logarithmic number of rounds over neighbours."""
        step = 1
        while step < len(maps):
            maps = maps[:step] + [maps[k - step].then(maps[k]) for k in range(step, len(maps))]
            step *= 2
        return maps

    def prefix_counts(self, text: str, chunk_chars: int) -> Iterator[tuple[int, int]]:
        """After each chunk of a text: how many characters and how many tokens (the last may still be open) it has so far.

        Chunks are mapped and scanned in blocks of BLOCK; a block hands its last prefix's state to the next, so memory
        follows a block's size and not the text's."""
        start = (0, -1, 0)
        state, chars, tokens, guess = start, 0, 0, start
        block, sizes, last = [], [], ""

        def scanned():
            nonlocal state, chars, tokens
            for size, prefix in zip(sizes, self.scan(block)):
                after, count = prefix.apply(state)
                chars += size
                yield chars, tokens + count
            state, tokens = after, tokens + count
            block.clear()
            sizes.clear()
            self.pinned = False
            if len(self.states) > self.STATES:
                self.reset()

        for chunk, open_, more in self.chunks(text, chunk_chars):
            if open_:  # the state that the bytes before the cut lead to from the start: mostly the true one
                guess = self.states[self.run(0, self.bpe.pieces(last[-WARM:])[-1].encode(), False)[0]]
            block.append(self.chunk_map(chunk, open_, more, guess if open_ else start))
            sizes.append(len(chunk))
            last = chunk
            if len(block) == self.BLOCK:
                yield from scanned()
        if block:
            yield from scanned()

    def count(self, text: str, chunk_chars: int) -> int:
        if not text:
            return 0
        count = 0
        for _, count in self.prefix_counts(text, chunk_chars):
            pass
        return count


class ChunkMap:
    """A chunk's map from entry state (by its values) to exit state and count.

    Only the chunk's head, the rest of a piece that was open, depends on the entry. A head that ends in the chunk leads to a
    state that is the same for all entries. A chunk within one piece is run once from the guessed entry, and its
    states are kept; from another entry it's run until it falls in with them, which takes about a token's length,
    so applying the map costs little and is always exact.
    """

    def __init__(self, of: CountTransducer, head: bytes, closed: bool, count: int, exit_: tuple | None, guess: tuple):
        self.of, self.head, self.closed, self.inner, self.exit = of, head, closed, count, exit_
        self.known: dict[tuple, tuple[tuple, int]] = {}
        self.trail = (array("i"), array("i"))
        if head and not closed:
            of.pinned = True
            state, n = of.run(of.entered(guess), head, False, self.trail)
            self.known[guess] = of.states[state], n

    def apply(self, entry: tuple) -> tuple[tuple, int]:
        if not self.head:
            return (self.exit if self.closed else entry), self.inner
        found = self.known.get(entry)
        if found is None:
            found = self.known[entry] = self.closing(entry) if self.closed else self.merging(entry)
        return found

    def closing(self, entry: tuple) -> tuple[tuple, int]:
        return self.exit, self.inner + self.of.run(self.of.entered(entry), self.head, True)[1]

    def merging(self, entry: tuple) -> tuple[tuple, int]:
        of, states, counts = self.of, *self.trail
        state, count = of.entered(entry), 0
        for k in range(len(self.head)):
            state, change = of.run(state, self.head[k : k + 1], False)
            count += change
            if state == states[k]:
                return of.states[states[-1]], count + counts[-1] - counts[k]
        return of.states[state], count

    def then(self, after: "ChunkMap | Composed") -> "Composed":
        return Composed(self, after)


class Composed:
    """The map of neighbouring chunks, from the maps of both parts; composition is associative."""

    def __init__(self, a, b):
        self.a, self.b, self.known = a, b, {}

    def apply(self, entry: tuple) -> tuple[tuple, int]:
        found = self.known.get(entry)
        if found is None:
            between, n = self.a.apply(entry)
            after, m = self.b.apply(between)
            found = self.known[entry] = after, n + m
        return found

    def then(self, after) -> "Composed":
        return Composed(self, after)


@lru_cache(maxsize=2)
def count_transducer(path: str) -> CountTransducer:
    return CountTransducer(word_bpe(path))


def let_go() -> None:
    """Forgets all vocabularies, which tasks without one needn't hold."""
    count_transducer.cache_clear()
    word_bpe.cache_clear()


KEPT["vocabulary"] = let_go
