"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained on the driver from LABELLED and its weights (a few kB) go to the executors.
Sequences are runs of at most WINDOW words of a line; a word without a digit and without an at sign
can only be `O`, so runs of such words need no decoding. Viterbi runs over all sequences of a batch
in numpy, one word position at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import id_and_text, release, sliced

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
WINDOW = 128
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EVIDENCE = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")

#: The labelled table: marked text, one line a row.
LABELLED = """
write to <email>maria.lopez@example.org</email> about the plan
her address is <email>j_smith+news@mail.example.com</email> and she answers
mail <email>admin@localhost</email> or ask at the desk
contact: <email>sales-team@shop.example.co</email>, open daily
the note from <email>k.27@mail3.example.com</email> came late
send it to <email>root@mailhost</email>
write <email>ann@intranet</email> and wait
he wrote @home and @noon in the margin
meet @ 5 near the gate
the host <ip>192.168.10.4</ip> did not answer
from <ip>10.0.0.17</ip> to <ip>172.16.254.1</ip> in two hops
server <ip>8.8.4.4</ip>, then a pause
version 2.0 of the tool and release 3.11.4 came out
see section 4.2.1 and table 7
chapter 10.3.2.1.7 has the list
paid with <card>4111111111111111</card> on monday
card <card>5500 0000 0000 0004</card> was refused
the number <card>4012-8888-8888-1881</card> is on file
charged <card>378282246310005</card> twice
account <card>6011000990139424</card>! was closed
call <phone>+1 (212) 555-0147</phone> before noon
phone <phone>(415) 555-2671</phone> or come by
ring <phone>212-555-0188</phone>, ask for ann
dial <phone>+44 20 7946 0958</phone> from abroad
fax <phone>+49 30 901820</phone> if needed
his mobile <phone>+33 6 12 34 56 78</phone> is off
text <phone>650.555.0199</phone> any time
in 1998 there were 1200 people and 35 dogs
on 2024-01-31 at 10:45 the train left
order 7781234 has 12 parts at 3.50 each
the key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" is old
sum of 1,250,000.00 was due in 30 days
isbn 978-3-16-148410-0 is in print
row 12 | 45 | 78 | 90
the 3rd floor, room 12b, seat 4-5
born 12.05.1987 in the north
id 00123456789 and code a1b2c3d4
the road runs 555 miles to mile 6437
plain words that mean no one at all
fax <phone>212-555-0162</phone> or write
tel <phone>415-555-0199</phone>
tel. <phone>312.555.0147</phone> ext 4
her number is <phone>646-555-0123</phone>
my phone <phone>(212) 555-0133</phone>
cell: <phone>(303) 555 0177</phone>, evenings
numbers <phone>650-555-0101</phone> and <phone>650-555-0102</phone> are the office
reach us at <phone>617-555-0181</phone>; we answer
dates 2023-11-05 and 2021-04-30 are set
parts 12-345-6789 and 555-12 are out of stock
between 100-200 and 300-400 units
the visa <card>4222 2222 2222 2220</card> expired
mastercard <card>5105105105105100</card> and <card>5105-1051-0510-5100</card>
node <ip>172.31.0.9</ip> and gateway <ip>192.168.0.1</ip>
ping <ip>10.1.2.3</ip>: no reply
bits 1 0 1 1 0 1 0 0 1
copyright 2019 the authors, all rights kept
"""


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the email pattern; each at sign is looked at once, so long runs of letters cost no retries."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def small_parts(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed; a failing match is dropped without a retry."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if small_parts(m.group())]
    for m in CARD.finditer(text):
        d = digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Letters as x, digits as d, runs collapsed, punctuation around the word dropped."""
    return re.sub(r"[0-9]+", "d", re.sub(r"[^\W\d_]+", "x", word.strip(".,;:!?\"'*%$#&|")))


def features(word: str) -> tuple[str, ...]:
    """Features of a word, all of it; those of short words are kept."""
    return _features(word) if len(word) <= 64 else _features.__wrapped__(word)


@lru_cache(maxsize=50_000)
def _features(word: str) -> tuple[str, ...]:
    n = sum(c in "0123456789" for c in word)
    bucket = "0" if n == 0 else "1" if n < 4 else "4" if n < 7 else "7" if n < 10 else "10" if n < 13 else "13" if n < 20 else "20"
    s = shape(word)
    return ("bias", "shape=" + s, "digits=" + bucket, f"dots={min(4, s.count('.'))}", f"at={'x@x' in s}", f"plus={s[:1] == '+'}", f"open={s[:1] == '('}", f"letters={'x' in s}", f"dash={'d-d' in s}")


class Field:
    """Linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def rows(self, words: list[str]) -> list[list[int]]:
        """Feature numbers of each word: its own and those of its neighbours; unknown ones are left out."""
        own = [features(w) for w in words]
        out = []
        for i, f in enumerate(own):
            around = [*f, *("before:" + x for x in (own[i - 1][1:3] if i else ("start",))), *("after:" + x for x in (own[i + 1][1:3] if i + 1 < len(own) else ("end",)))]
            out.append([self.names[x] for x in around if x in self.names])
        return out

    def scores(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores, sequences x words x labels, and lengths; labels that a word cannot have get a large negative score."""
        lengths = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), int(lengths.max()), len(LABELS)))
        for i, words in enumerate(sequences):
            for j, f in enumerate(self.rows(words)):
                out[i, j] = self.emit[f].sum(axis=0)
                if not EVIDENCE.search(words[j]):
                    out[i, j, 1:] -= 1e6
        return out, lengths

    def viterbi(self, sequences: list[list[str]]) -> list[list[int]]:
        scores, lengths = self.scores(sequences)
        n, longest, _ = scores.shape
        back = np.zeros((longest, n, len(LABELS)), np.int8)
        best = scores[:, 0].copy()
        for t in range(1, longest):
            paths = best[:, :, None] + self.move[None]
            back[t] = paths.argmax(axis=1)
            live = t < lengths
            best[live] = (paths.max(axis=1) + scores[:, t])[live]
        label = best.argmax(axis=1)
        out = np.zeros((n, longest), np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            at = t < lengths
            out[at, t] = label[at]
            if t:
                label = np.where(at, back[t][rows, label], label)
        return [out[i, : lengths[i]].tolist() for i in range(n)]


def labelled_rows(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Words and labels of each line of marked text."""
    out = []
    for line in filter(None, table.strip().split("\n")):
        words, labels, kind = [], [], "O"
        for part in re.split(r"(</?(?:email|ip|card|phone)>)", line):
            m = re.fullmatch(r"<(/?)(\w+)>", part)
            if m:
                kind = "O" if m[1] else m[2]
            else:
                for w in WORD.findall(part):
                    if kind == "O" and words and not re.search(r"\w", w) and not part.startswith(" "):
                        continue  # punctuation that stands right after a marked word
                    words.append(w)
                    labels.append(LABELS.index(kind))
        out.append((words, labels))
    return out


@lru_cache(maxsize=1)
def trained(rounds: int = 120, step: float = 0.5, decay: float = 1e-3) -> Field:
    """Weights by gradient ascent on the penalised log-likelihood of the labelled table (forward-backward)."""
    rows = labelled_rows()
    names: dict[str, int] = {}
    probe = Field(names, np.zeros((0, len(LABELS))), np.zeros((0, 0)))
    for words, _ in rows:
        own = [features(w) for w in words]
        for i, f in enumerate(own):
            for x in (*f, *("before:" + y for y in (own[i - 1][1:3] if i else ("start",))), *("after:" + y for y in (own[i + 1][1:3] if i + 1 < len(own) else ("end",)))):
                names.setdefault(x, len(names))
    k = len(LABELS)
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    data = [(np.array([np.bincount(f, minlength=len(names)) for f in probe.rows(words)], float), np.array(labels)) for words, labels in rows]
    for _ in range(rounds):
        g_emit, g_move = -decay * emit * len(data), -decay * move * len(data)
        for x, y in data:
            s = x @ emit
            n = len(y)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = s[0]
            for t in range(1, n):
                a[t] = s[t] + np.logaddexp.reduce(a[t - 1][:, None] + move, axis=0)
            for t in range(n - 2, -1, -1):
                b[t] = np.logaddexp.reduce(move + (s[t + 1] + b[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(a[-1])
            p = np.exp(a + b - z)
            d = -p
            d[np.arange(n), y] += 1
            g_emit += x.T @ d
            for t in range(1, n):
                g_move[y[t - 1], y[t]] += 1
                g_move -= np.exp(a[t - 1][:, None] + move + (s[t] + b[t])[None] - z)
        emit += step * g_emit / len(data)
        move += step * g_move / len(data)
    return Field(names, emit, move)


def plausible(text: str, kind: str) -> bool:
    """A shape check of what the field proposes."""
    d = digits_of(text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]*\w@\w[^\s@]*", text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text) is not None
    if kind == "card":
        return 14 <= len(d) <= 19 and re.fullmatch(r"[0-9 -]+", text) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"[0-9+() .-]+", text) is not None


EDGE = ".,;:!?\"'*%$#&|"


def windows(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The words of a line in windows of WINDOW or more that end, and whose next one begins, with the same word without evidence.

    Such a word has no label but O, so the best paths of the windows are the best path of the line.
    """
    out, k = [], 0
    while k < len(words):
        end = min(k + WINDOW, len(words))
        while end < len(words) and EVIDENCE.search(text[words[end - 1][0] : words[end - 1][1]]):
            end += 1
        out.append(words[k:end])
        k = end - 1 if end < len(words) else end
    return out


def proposed(field: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of the field in each text."""
    where, sequences = [], []
    for i, text in enumerate(texts):
        if not EVIDENCE.search(text):
            continue
        seen = -1
        for hit in EVIDENCE.finditer(text):
            if hit.start() <= seen:
                continue
            a, b = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.start())
            b = len(text) if b < 0 else b
            seen = b
            words = [(m.start(), m.end()) for m in WORD.finditer(text, a, b)]
            for part in windows(text, words):
                if EVIDENCE.search(text, part[0][0], part[-1][1]):
                    where.append((i, part))
                    sequences.append([text[s:e] for s, e in part])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    first = 0
    while first < len(sequences):
        last, longest = first + 1, len(sequences[first])
        while last < min(len(sequences), first + 256) and max(longest, len(sequences[last])) * (last + 1 - first) <= 512 * WINDOW:
            longest = max(longest, len(sequences[last]))
            last += 1
        for (i, part), labels in zip(where[first:last], field.viterbi(sequences[first:last])):
            at = 0
            while at < len(part):
                end = at + 1
                if labels[at]:
                    while end < len(part) and labels[end] == labels[at] and LABELS[labels[at]] in ("phone", "card"):
                        end += 1
                    kind, (start, stop) = LABELS[labels[at]], (part[at][0], part[end - 1][1])
                    while start < stop and texts[i][start] in EDGE:
                        start += 1
                    while start < stop and texts[i][stop - 1] in EDGE:
                        stop -= 1
                    if plausible(texts[i][start:stop], kind):
                        out[i].append((start, stop, kind))
                at = end
        first = last
    return out


def spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; a proposed span stays out where it touches a base one."""
    base = [base_spans(t) if EVIDENCE.search(t) else [] for t in texts]
    out = []
    for own, more in zip(base, proposed(field, texts)):
        taken = np.array([(a, b) for a, b, _ in own]).reshape(-1, 2)
        added = [s for s in more if not ((taken[:, 0] < s[1]) & (s[0] < taken[:, 1])).any()]
        out.append((own, sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def written_spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): base counts and digest, and all spans.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; lines and words of any length are
    looked at whole; repeated rows repeat; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        release()
        for whole in batches:
            for b in sliced(whole):
                found = spans(sent.value, b.column(1).to_pylist())
                counts = [[sum(s[2] == k for s in own) for own, _ in found] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written_spans(own).encode()).hexdigest() for own, _ in found], pa.string()), pa.array([written_spans(every) for _, every in found], pa.string()), pa.array([len(every) - len(own) for own, every in found], pa.int64())],
                    names=["doc_id", *("n_" + k for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlapping ones as one) replaced by the name of its kind."""
    out, at = [], 0
    for a, b, kind in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data masked in `text`: base spans and added ones, overlapping ones as one.

    Null texts stay null, empty ones empty; all other columns, whatever their names and types, stay; repeated rows
    repeat; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kinds = docs.schema
    place = docs.columns.index("text")

    def run(batches):
        release()
        for whole in batches:
            for b in sliced(whole):
                texts = b.column(place).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None and EVIDENCE.search(t)]
                for i, (_, every) in zip(some, spans(sent.value, [texts[i] for i in some])):
                    texts[i] = masked(texts[i], every)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, kinds)
