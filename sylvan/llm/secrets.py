"""Secret scan by grammar inference.

Credentials that the base patterns label are grouped by kind.  Each kind's strings, written as character classes, form a
prefix tree; statistically compatible states (Hoeffding bound on every symbol and on ending, recursively) are merged
from the root outwards, which gives a probabilistic automaton of the kind's format.  Every run of the credentials'
characters, of the least length of any kind, is then scored to its end under all automata against a class-bigram model of
ordinary long tokens (words and numbers joined by signs); a mean log-likelihood ratio of ``least_ratio`` or more makes it
a span of kind ``format``.  A run that is none is judged without dots around it, then in its parts.  Base spans always stay.

Training takes at most SAMPLE strings a kind and SAMPLE ordinary words, of each hash slot the one with the smallest hash,
so it is the same however rows are partitioned; its result is a few kilobytes that travel with the task.  The scan is one pass in
Arrow batches without a shuffle; each text is scanned whole.

Spans are in code points, end exclusive, and cover the whole match.  Edge cases: null text is empty and has no spans;
texts without any labelled credential in the corpus give base spans only; repeated rows each get their own result; an
empty table gives no rows; the input's other columns are ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read
from .wordhash import slices

#: The base patterns of the query's contract, in its order of kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 12, "access": 18, "hex": 16}
CANDIDATE = rf"[A-Za-z0-9+/_.=-]{{{min(LEAST.values())},}}"
#: A run as a whole, without dots around it, between dots, between all signs that also separate.
PARTS = tuple(re.compile(p) for p in (".+", r"[^.](?:.*[^.])?", r"[^.]+", r"[^.=/+]+"))
#: LONGEST bounds the strings that train; tokens are scored whole.
SAMPLE, LONGEST, RATIO, ALPHA = 256, 1024, 0.35, 0.05
CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}
END = "$"


def classes(token: str) -> str:
    """One symbol for each character: digit, a-f, g-z, A-F, G-Z, others as they are."""
    return re.sub(
        r"[0-9]|[a-f]|[g-z]|[A-F]|[G-Z]",
        lambda m: "d" if m[0] <= "9" else "H" if m[0] <= "F" else "U" if m[0] <= "Z" else "h" if m[0] <= "f" else "l",
        token,
    )


class State:
    __slots__ = ("count", "end", "next", "seen")

    def __init__(self) -> None:
        self.count, self.end, self.next, self.seen = 0, 0, {}, defaultdict(int)


def prefix_tree(strings: list[str]) -> State:
    """Counts of prefixes; a string over LONGEST is cut and has no end."""
    root = State()
    for s in strings:
        at = root
        at.count += 1
        for c in s[:LONGEST]:
            at.seen[c] += 1
            at = at.next.setdefault(c, State())
            at.count += 1
        at.end += len(s) <= LONGEST
    return root


def apart(a: int, n: int, b: int, m: int) -> bool:
    """Whether shares a / n and b / m differ by more than the Hoeffding bound."""
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (n**-0.5 + m**-0.5)


def compatible(x: State, y: State) -> bool:
    todo, met = [(x, y)], set()
    while todo:
        a, b = todo.pop()
        if (id(a), id(b)) in met or not a.count or not b.count:
            continue
        met.add((id(a), id(b)))
        if apart(a.end, a.count, b.end, b.count):
            return False
        for c in {*a.seen, *b.seen}:
            if apart(a.seen.get(c, 0), a.count, b.seen.get(c, 0), b.count):
                return False
            if c in a.next and c in b.next:
                todo.append((a.next[c], b.next[c]))
    return True


def fold(x: State, y: State) -> None:
    """Adds the tree under y to the automaton at x."""
    todo = [(x, y)]
    while todo:
        a, b = todo.pop()
        a.count, a.end = a.count + b.count, a.end + b.end
        for c, n in b.seen.items():
            a.seen[c] += n
        for c, child in b.next.items():
            if c in a.next:
                todo.append((a.next[c], child))
            else:
                a.next[c] = child


def infer(strings: list[str]) -> list[dict]:
    """The merged automaton: for each state, log probabilities of symbols (and of END) and the next states."""
    red = [prefix_tree(strings)]
    while True:
        blue = next(((r, c, s) for r in red for c, s in sorted(r.next.items()) if all(s is not x for x in red)), None)
        if blue is None:
            break
        r, c, s = blue
        same = next((x for x in red if compatible(x, s)), None)
        if same is None:
            red.append(s)
        else:
            r.next[c] = same
            fold(same, s)
    number = {id(s): k for k, s in enumerate(red)}
    out = []
    for s in red:
        total = s.count + 0.5
        log = {c: math.log((n + 0.01) / total) for c, n in s.seen.items()}
        out.append({"log": log | {END: math.log((s.end + 0.01) / total)}, "next": {c: number[id(x)] for c, x in s.next.items()}})
    return out


def bigrams(strings: list[str]) -> dict[str, float]:
    """Log probability of a class, or of the end, after a class in ordinary tokens."""
    pair, one = defaultdict(int), defaultdict(int)
    for s in strings:
        for a, b in zip("^" + s[:LONGEST], s[:LONGEST] + END * (len(s) <= LONGEST)):
            pair[a + b] += 1
            one[a] += 1
    return {p: math.log((n + 0.5) / (one[p[0]] + 6)) for p, n in pair.items()}


def ratio(token: str, automata: list[list[dict]], ordinary: dict[str, float]) -> float:
    """Mean log-likelihood ratio, a symbol (END is one), of the likeliest automaton against the model of ordinary tokens."""
    s = classes(token)
    best = -math.inf
    for states in automata:
        at, total = 0, 0.0
        for c in s:
            step = states[at]["log"].get(c)
            if step is None:
                total = -math.inf
                break
            total, at = total + step, states[at]["next"][c]
        best = max(best, total + states[at]["log"][END])
    if best == -math.inf:
        return best
    plain = sum(ordinary.get(a + b, -7.0) for a, b in zip("^" + s, s + END))
    return (best - plain) / (len(s) + 1)


def format_spans(run: str, model: dict, least_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the run, or of its largest parts, that an automaton explains."""
    tried: set[tuple[int, int]] = set()
    for part in PARTS:
        spans = [m.span() for m in part.finditer(run)]
        fresh = [(a, b) for a, b in spans if b - a >= min(LEAST.values()) and (a, b) not in tried]
        found = [(a, b) for a, b in fresh if ratio(run[a:b], model["automata"], model["ordinary"]) >= least_ratio]
        if found:
            return found
        tried.update(fresh)
    return []


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Automata of the base kinds and the model of ordinary tokens, from bounded samples with the smallest hashes."""
    pick = lambda p, g, kind: F.transform(
        F.regexp_extract_all("text", F.lit(p), F.lit(g)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    )
    # ordinary: what is left without the labelled credentials, where no letter touches a digit
    rest = F.regexp_replace("text", ASSIGN, " ")
    plain = F.filter(F.regexp_extract_all(rest, F.lit(CANDIDATE), F.lit(0)), lambda v: ~v.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    tagged = F.concat(
        pick(ASSIGN, 1, "assign"), pick("AKIA[A-Z0-9]{14,}", 0, "access"), pick("[0-9a-f]{16,}", 0, "hex"),
        F.transform(plain, lambda v: F.struct(F.lit("word").alias("kind"), v.alias("value"))),
    )
    found = docs.select(F.explode(tagged).alias("x")).select("x.kind", F.substring("x.value", 1, LONGEST + 1).alias("value"))
    found = found.filter((F.col("kind") != "assign") | (F.length("value") >= LEAST["assign"]))
    # the smallest hashes of each kind: partial sets of bounded size in each task, whole ones at the end; ordinary tokens
    # come back in other places, which bare keys do not, so tokens seen once stand in only where none is seen twice
    found = found.groupBy("kind", "value").agg((F.count("*") < 2).alias("once"))
    once = F.when(F.col("kind") == "word", F.col("once")).otherwise(False)
    least = F.min(F.struct(once.alias("once"), F.xxhash64("value").alias("h"), "value"))
    found = found.groupBy("kind", F.pmod(F.xxhash64("value"), F.lit(sample)).alias("slot")).agg(least.alias("m"))
    strings: dict[str, list[str]] = defaultdict(list)
    rows = found.select("kind", "m.value", "m.once").collect()
    repeated = any(r.kind == "word" and not r.once for r in rows)
    for row in rows:
        if not (row.once and repeated):
            strings[row.kind].append(row.value)
    strings = {k: sorted(v) for k, v in strings.items()}
    automata = [infer([classes(v) for v in strings[k]]) for k in KINDS[:3] if strings.get(k)]
    return {"automata": automata, "ordinary": bigrams([classes(v) for v in strings.get("word", [])])}


def spans_of(text: str, model: dict, patterns, memo: dict, least_ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    assign, access, hexes, candidate = patterns
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    if model["automata"]:
        base = list(out)
        for m in candidate.finditer(text):
            run, at = m[0], m.start()
            if any(a <= at and m.end() <= b for a, _, b in base):
                continue
            if run not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[run] = format_spans(run, model, least_ratio)
            spans = [(at + a, at + b) for a, b in memo[run]]
            out += [(a, 3, b) for a, b in spans if not any(x <= a and b <= y for x, _, y in base)]
    return sorted(out)


def compiled():
    return re.compile(ASSIGN, re.ASCII), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}"), re.compile(CANDIDATE)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: dict | None = None, least_ratio: float = RATIO) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans as text."""
    model = train(docs) if model is None else model

    def run(batches):
        patterns, memo = compiled(), {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = [spans_of(t or "", model, patterns, memo, least_ratio) for t in batch.column("text").to_pylist()]
            kinds = [[k for _, k, _ in r] for r in rows]
            digests = [hashlib.sha256(joined([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                **{f"n_{name}": pa.array([x.count(k) for x in kinds], pa.int64()) for k, name in enumerate(KINDS[:3])},
                "base_sha256": pa.array(digests, pa.string()),
                "spans": pa.array([joined(r) for r in rows], pa.string()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def redact(docs: DataFrame, mark: str = "[SECRET]", least_ratio: float = RATIO) -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one), all columns kept; n_chars follows."""
    model = train(docs)
    counted = "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")

    def run(batches):
        patterns, memo = compiled(), {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            names = batch.schema.names
            at = names.index("text")
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                found = spans_of(text or "", model, patterns, memo, least_ratio)
                if found:
                    parts, end = [], 0
                    for a, _, b in found:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    texts[k] = "".join(parts) + text[end:]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted:
                n = names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scan(spark, sf_dir):
    """The contract's columns for every document."""
    return scan(read(spark, sf_dir, "documents"))
