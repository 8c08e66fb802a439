"""Language identification by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton. A text is parsed greedily against it: from
each place the longest string that occurs in the labelled text is one phrase. A language costs
phrases x log2(training length) / letters bits a letter; the language with the least cost wins.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.shared import id_and_text, kept, sliced

#: Bounds of the training sample: rows per language, code points per row, code points per language.
TRAIN_ROWS, ROW_CHARS, TRAIN_CHARS = 48, 1000, 12000
#: Most languages that are learned: those with the most labelled rows, so a dirty column of labels costs no more.
LANGUAGES = 200
#: Texts are parsed in blocks of so many normalised characters, side by side; phrases go on across blocks.
BLOCK_CHARS = 2048
#: Languages that texts go through together.
PACK = 8
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Word characters that are no letters (fractions, raised and circled numbers) are left by the pattern above.
NUMERALS = regex.compile(r"[^\p{L}]+")


def normalised(text: str) -> str:
    """Lower-case letters, each other run as one space; empty if there is no letter."""
    clean = NOT_LETTERS.sub(" ", text.lower())
    return (clean if clean.isascii() else NUMERALS.sub(" ", clean)).strip()


def displaced(go: list[dict[int, int]], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to) of sparse transition rows: that of state s and letter c lies at base[s] + c where owner is s; rows are laid into each other's gaps, wide ones first."""
    owner, to = [0] * (2 * letters), [0] * (2 * letters)
    base = np.zeros(len(go), np.int32)
    free = last = letters  # no cell from `letters` to `free` is free; wide rows go on from where the last one went
    for s in sorted(range(1, len(go)), key=lambda s: -len(go[s])):
        edges = sorted(go[s])
        if not edges:
            continue
        while free < len(owner) and owner[free]:
            free += 1
        at = free if len(edges) == 1 else max(free, last)
        while True:
            if at + letters >= len(owner):
                owner += [0] * (len(owner) + letters)
                to += [0] * (len(owner) - len(to))
            b = at - edges[0]
            if not owner[at] and not any(owner[b + c] for c in edges[1:]):
                break
            at += 1
        base[s], last = b, at if len(edges) > 1 else last
        for c in edges:
            owner[b + c], to[b + c] = s, go[s][c]
    end = max((i for i, o in enumerate(owner) if o), default=0) + letters + 1
    pad = [0] * max(0, end - len(owner))
    return base, np.array((owner + pad)[:end], np.int32), np.array((to + pad)[:end], np.int32)


class SuffixAutomaton:
    """Strings that occur in `codes`, as sparse transition rows; 0 is no transition, state 1 the start."""

    def __init__(self, codes: list[int], letters: int):
        go: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in codes:
            cur = len(go)
            go.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if not p:
                link[cur] = 1
            else:
                q = go[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(go)
                    go.append(dict(go[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p and go[p].get(c) == q:
                        go[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size = len(codes)
        base, owner, to = displaced(go, letters)
        self.base, self.cells = base.astype(np.int64), (owner.astype(np.int64) << 32) | to
        #: Where a phrase begins anew with each letter, and the letters that no training text holds: after one the next phrase is open.
        self.again, self.lacks = np.ones(letters, np.int64), np.ones(letters, bool)
        for c, at in go[1].items():
            self.again[c], self.lacks[c] = at, False


class Pack:
    """Automata that texts go through together: states are numbered through, letters have a number a language."""

    def __init__(self, automata: list[SuffixAutomaton], letters: int):
        self.width, self.letters = len(automata), letters
        states = np.cumsum([0, *(len(a.base) for a in automata)])
        places = np.cumsum([0, *(len(a.cells) for a in automata)])
        of = lambda k, x: np.where(x > 0, x + states[k], 0)
        self.starts = states[:-1] + 1
        self.base = np.concatenate([a.base + places[k] - k * letters for k, a in enumerate(automata)])
        self.cells = np.concatenate([(of(k, a.cells >> 32) << 32) | of(k, a.cells & 0xFFFFFFFF) for k, a in enumerate(automata)])
        self.again = np.concatenate([a.again + states[k] for k, a in enumerate(automata)])
        self.lacks = np.concatenate([a.lacks for a in automata])

    def phrases(self, flat, start, left, order, live, steps, later, last) -> np.ndarray:
        """blocks x languages: phrases that end in each block; see Languages.phrases."""
        wide, n_blocks = self.width, len(start)
        starts, shift = np.tile(self.starts, n_blocks), np.tile(np.arange(wide) * self.letters, n_blocks)

        def step(state: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """States after the letters, where phrases ended, and where a letter that the language lacks ended the open phrase and is one of its own."""
            cell = self.cells[self.base[state] + c]
            ended = (cell >> 32) != state
            lone = np.flatnonzero(self.lacks[c])
            return np.where(ended, self.again[c], cell & 0xFFFFFFFF), ended, lone[state[lone] != own[lone]]

        def counted(ended: np.ndarray, lone: np.ndarray) -> np.ndarray:
            n = ended.astype(np.int64)
            n[lone] += 1
            return n

        s, n = starts.copy(), np.zeros(n_blocks * wide, np.int64)
        for m, c in zip(live * wide, steps):
            s[:m], ended, lone = step(s[:m], np.repeat(c, wide) + shift[:m], starts[:m])
            n[:m] += ended
            n[lone] += 1
        unsorted = lambda x: np.ascontiguousarray(x.reshape(n_blocks, wide)[np.argsort(order, kind="stable")]).reshape(-1)
        state, count = unsorted(s), unsorted(n)
        start, left = np.repeat(start, wide), np.repeat(left, wide)
        later = (later[:, None] * wide + np.arange(wide)).reshape(-1)
        single, alone, entry = count.copy(), state.copy(), starts.copy()
        changed = later[state[later - wide] != starts[later]]
        while len(changed):
            entry[changed] = state[changed - wide]
            exits = state.copy()
            exits[changed] = alone[changed]
            which, a, b, more, i = changed, entry[changed], starts[changed], np.zeros(len(changed), np.int64), 0
            count[changed] = single[changed]
            while len(which):
                c, own = flat[start[which] + i] + shift[which], starts[which]
                a, *ended = step(a, c, own)
                b, *once = step(b, c, own)
                more += counted(*ended) - counted(*once)
                i += 1
                met, over = a == b, left[which] == i
                done = met | over
                if done.any():
                    count[which[done]] += more[done]
                    exits[which[over & ~met]] = a[over & ~met]
                    which, a, b, more = which[~done], a[~done], b[~done], more[~done]
            state = exits
            changed = later[state[later - wide] != entry[later]]
        count, state = count.reshape(n_blocks, wide), state.reshape(n_blocks, wide)
        count[last] += state[last] != self.starts
        return count


class Languages:
    """Automata of all languages over one alphabet; letters outside it are one code that no training text holds."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        alphabet = sorted(set("".join(texts.values())))
        self.other = len(alphabet)
        self.code = {c: i for i, c in enumerate(alphabet)}
        self.automata = [SuffixAutomaton([self.code[c] for c in texts[n]], self.other + 1) for n in self.names]
        self.packs = [Pack(self.automata[i : i + PACK], self.other + 1) for i in range(0, len(self.automata), PACK)]
        self.bits = np.array([np.log2(max(2, a.size)) for a in self.automata])
        wide = max(self.code, default=" ")
        self.by_point = np.full(ord(wide) + 2, self.other, np.int32)
        for c, i in self.code.items():
            self.by_point[ord(c)] = i

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return self.by_point[np.minimum(points, len(self.by_point) - 1)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """texts x languages: phrases of each text.

        All blocks of all texts advance together, one letter a step, first as if each began a phrase. Then the
        blocks that go on from an open phrase are run again from the state before them, until they are in the
        state they were in the first time: from there on nothing changes.
        """
        codes = [self.codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes])
        blocks = -(-sizes // BLOCK_CHARS)
        owner = np.repeat(np.arange(len(texts)), blocks)
        flat = np.concatenate([*codes, np.zeros(BLOCK_CHARS, np.int32)]).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[owner] + nth * BLOCK_CHARS
        left = np.minimum(sizes[owner] - nth * BLOCK_CHARS, BLOCK_CHARS)
        order = np.argsort(-left, kind="stable")
        live = np.searchsorted(-left[order], -np.arange(int(left.max(initial=0))), side="left")  # blocks longer than each step
        steps = [np.take(flat, start[order[:m]] + i) for i, m in enumerate(live)]  # letters of each step, whatever the language
        last = np.cumsum(blocks)[blocks > 0] - 1
        found = [p.phrases(flat, start, left, order, live, steps, np.flatnonzero(nth > 0), last) for p in self.packs] if len(owner) else []
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, count in enumerate(np.concatenate(found, axis=1).T if found else ()):
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [normalised(t) if t else "" for t in texts]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(clean) if t]
        if some and self.names:
            cost = self.phrases([clean[i] for i in some]) * self.bits
            best = cost.argmin(axis=1)
            least = cost.min(axis=1)
            second = np.partition(cost, 1, axis=1)[:, 1] if len(self.names) > 1 else least * 2
            sure = np.clip(1 - least / np.maximum(second, 1e-9), 0, 1)
            for i, b, s in zip(some, best, sure):
                lang[i], score[i] = self.names[b], float(s)
        return lang, score


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_texts(docs: DataFrame, rows: int = TRAIN_ROWS, row_chars: int = ROW_CHARS, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """A bounded sample of labelled text: of the LANGUAGES languages with the most labelled rows (ties by name) the `rows` rows each that are not held out with the least hash of doc_id, an excerpt of each.

    The rank filter is pushed below the shuffle, so a language with most rows sends `rows` rows a task.
    """
    n = F.length("text")
    at = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(7)), F.greatest(n - row_chars, F.lit(0)) + 1)
    labelled = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    most = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    sample = (
        labelled.filter(F.col("lang").isin(most))
        .select("lang", F.xxhash64("doc_id", F.lit(5)).alias("draw"), F.expr("doc_id").alias("doc_id"), F.col("text").substr(at.cast("int"), F.lit(row_chars)).alias("excerpt"))
        .withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "excerpt")))
        .filter(F.col("nth") <= rows)
    )
    out: dict[str, str] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["nth"])):
        text = out.get(r["lang"], "")
        if len(text) < chars:
            out[r["lang"]] = (text + " " + normalised(r["excerpt"])).strip()[:chars]
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): score is 1 - least cost / second least cost.

    Null texts and texts without a letter are `und` with score 0, and so is every text where nothing
    is labelled; ties go to the first language by name; texts of any length are parsed whole; repeated
    rows repeat; a null doc_id is not held out and never learned from; an empty table gives no rows; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(training_texts(named, **bounds))
    key = uuid.uuid4().hex

    def run(batches):
        languages = kept(key, lambda: Languages(sent.value))
        for whole in batches:
            for b in sliced(whole):
                lang, score = languages.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = id_and_text(named).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
