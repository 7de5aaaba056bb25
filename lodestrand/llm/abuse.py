"""Problem 8: scores for abusive or sexual language, by a subsequence-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, SPAN, DECAY = 4, 6, 0.6
BITS = 5
FEATURES = 1 << (BITS * ORDER)
DIGIT, SPACE, MARK, STAR, FOREIGN, DROP = 27, 28, 29, 30, 31, 255
# Cyrillic and Greek letters that look like a Latin one, and that letter.
LOOKALIKES = dict(zip("абвгдеікмнопрстухѕјԁɡһαβεικνορτυχ", "abbrdeikmhonpctyxsjdghabeikvoptyx", strict=True))
# Signs written for a letter, and that letter.
SIGNS = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "i", "€": "e"}
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ ._*\-]){2,}[^\W\d_](?!\w)")
BREAK = re.compile(r"[.!?;]+[\s\"'»)]+|\s*\n\s*|[.!?]+$")


@lru_cache(1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each character of the first plane its symbol, and the letter it may be written for."""
    table = np.full(0x10000, FOREIGN, np.uint8)
    letter = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFKD", c)[:1].lower()[:1]
        base = LOOKALIKES.get(base, base)
        if kind[0] == "L" and not "a" <= base <= "z":
            # Letters of other scripts: the first letter of their name, as in "CYRILLIC SMALL LETTER ZHE"; signs without a
            # sound in their name are spread over all letters.
            name = re.search(r" (?:LETTER|SYLLABLE)(?: SMALL| FINAL| MEDIAL| INITIAL)* ([A-Z])", unicodedata.name(c, ""))
            base = name[1].lower() if name else chr(97 + i * 7 % 26)
        if "a" <= base <= "z":
            table[i] = ord(base) - 96
        elif kind in ("Mn", "Cf", "Me"):
            table[i] = DROP
        elif kind[0] == "N":
            table[i] = DIGIT
        elif kind[0] == "Z" or c.isspace():
            table[i] = SPACE
        elif c == "*":
            table[i] = STAR
        elif kind[0] in "PSC":
            table[i] = MARK
    for sign, for_letter in SIGNS.items():
        letter[ord(sign)] = ord(for_letter) - 96
    return table, letter


def passages(text: str | None, longest: int = 100, width: int = 80) -> list[str]:
    """Sentences and lines of the whole text; longer ones as overlapping windows of `width`, half a window apart."""
    out = []
    for s in BREAK.split(SPACED.sub(lambda m: m.group().replace(m.group()[1], ""), text or "")):
        s = s.strip()
        if len(s) > longest:
            out += [s[i : i + width] for i in range(0, len(s) - width // 2, width // 2)]
        elif s:
            out.append(s)
    return out


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each with SPAN zeros behind it; where each begins; its number of symbols."""
    pad = "\x00" * SPAN
    points = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 0x10000, points, 0xFFFD)
    table, letter = _symbols()
    x, as_letter = table[points], letter[points]
    solid = ((x > 0) & (x <= 26)) | (as_letter > 0)
    before, behind = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    free = (as_letter > 0) & np.where(x == DIGIT, before & behind, before | behind)
    x = np.where(free, as_letter, x)
    x[points == 0] = 0
    # One symbol for a run of digits or blanks; marks and format characters inside letters are left out.
    same = np.concatenate([[False], (x[1:] == x[:-1]) & ((x[1:] == DIGIT) | (x[1:] == SPACE) | (x[1:] == STAR))])
    keep = (x != DROP) & ~same
    owner = np.repeat(np.arange(len(texts)), [len(t) + SPAN for t in texts])
    x, owner = x[keep].astype(np.int32), owner[keep]
    size = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    return x, begin, size - SPAN


def occurrences(x: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of a subsequence of ORDER symbols within SPAN: the features from every place, and their weight.
    Subsequences that hold a padding zero are feature 0."""
    n = len(x)
    at = [np.concatenate([x[k:], np.zeros(min(k, n), np.int32)]) for k in range(SPAN)]
    for rest in combinations(range(1, SPAN), ORDER - 1):
        f, whole = x, x > 0
        for k in rest:
            f = (f << BITS) | at[k]
            whole = whole & (at[k] > 0)
        yield np.where(whole, f, 0), DECAY ** (rest[-1] + 1 - ORDER)


def score_texts(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    if not texts:
        return np.zeros(0, np.float32)
    x, begin, size = encode(texts)
    total = np.zeros(len(x), np.float32)
    for f, w in occurrences(x):
        total += np.float32(w) * weights[f]
    return np.add.reduceat(total, begin) / np.sqrt(np.maximum(size, 12)) + bias


def _feature_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of each text's feature vector, divided by the root of its length."""
    x, begin, size = encode(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([begin, [len(x)]])))
    keys, vals = [], []
    for f, w in occurrences(x):
        ok = f > 0
        keys.append(owner[ok].astype(np.int64) * FEATURES + f[ok])
        vals.append(np.full(ok.sum(), w, np.float32))
    key, val = np.concatenate(keys), np.concatenate(vals)
    uniq, inv = np.unique(key, return_inverse=True)
    total = np.bincount(inv, val, len(uniq)).astype(np.float32)
    text = uniq // FEATURES
    return text, uniq % FEATURES, total / np.sqrt(np.maximum(size[text], 12)).astype(np.float32)


def _kernel(texts: list[str], marks: tuple, m: int, block: int = 128) -> np.ndarray:
    """The kernel between texts and m landmarks, whose feature rows are `marks`: each text's values times the landmarks'
    values of the features they share."""
    known, inv = np.unique(marks[1], return_inverse=True)
    place = np.full(FEATURES, -1, np.int32)
    place[known] = np.arange(len(known))
    place[0] = -1
    mine = []
    for lo in range(0, len(texts), 1000):
        text, feature, value = _feature_rows(texts[lo : lo + 1000])
        at = place[feature]
        hit = at >= 0
        mine.append((text[hit] + lo, at[hit], value[hit]))
    text, at, value = (np.concatenate(x) for x in zip(*mine, strict=True))
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    out = np.zeros((len(texts), m), np.float32)
    for lo in range(0, m, block):
        hi = min(m, lo + block)
        own = (marks[0] >= lo) & (marks[0] < hi)
        dense = np.zeros((len(known), hi - lo), np.float32)
        dense[inv[own], marks[0][own] - lo] = marks[2][own]
        for t in range(len(texts)):
            rows = slice(ends[t], ends[t + 1])
            out[t, lo:hi] = value[rows] @ dense[at[rows]]
    return out


def _spread(texts: list[str], m: int) -> np.ndarray:
    """Up to m of the texts that together span most of the kernel's space: pivots of an incomplete Cholesky factor."""
    k = _kernel(texts, _feature_rows(texts), len(texts)).astype(np.float64)
    left, factor, picked = np.diag(k).copy(), np.zeros((len(texts), min(m, len(texts)))), []
    for j in range(factor.shape[1]):
        i = int(np.argmax(left))
        if left[i] < 1e-9:
            break
        picked.append(i)
        factor[:, j] = (k[:, i] - factor[:, :j] @ factor[i, :j]) / np.sqrt(left[i])
        left -= factor[:, j] ** 2
    return np.array(picked, dtype=int)


def _squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Primal L2 support vector machine by Newton steps; the last entry is the bias."""
    z1 = np.hstack([z, np.ones((len(z), 1), np.float32)]).astype(np.float64)
    v = np.zeros(z1.shape[1])
    reg = np.eye(len(v))
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        miss = 1 - y * (z1 @ v)
        on = miss > 0
        a, c = z1[on], cost[on]
        new = np.linalg.solve(reg + 2 * (a * c[:, None]).T @ a, 2 * (a * c[:, None]).T @ y[on])
        if np.allclose(new, v, atol=1e-5):
            break
        v = new
    return v


def fit(
    docs: list[tuple[str, int]], landmarks: int = 256, negatives: int = 4000, rounds: int = 4, cost: float = 4.0, first_cost: float = 0.2, odds: float = 3.0, seed: int = 8
) -> tuple[np.ndarray, float]:
    """Weights of all subsequence features, and the bias, from labelled documents.

    Documents are labelled, passages are not: a document marked abusive holds at least one such passage. Passages about
    as frequent in unmarked documents are taken as harmless; the machine is trained on the others, then each marked document
    keeps the passages the machine finds abusive, and training is repeated. A marked document with none, or an unmarked one
    with clear abuse, is a wrong label and sits out. Landmarks are drawn from both sides; the trained machine, linear in
    the kernel to the landmarks, is folded into one weight for each feature.
    """
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    parts: list[list[int]] = []
    texts: list[str] = []
    for text, _ in docs:
        mine = []
        for p in passages(text):
            k = " ".join(re.findall(r"[^\W\d_]+", p.casefold()))
            if k not in seen:
                seen[k] = len(texts)
                texts.append(p)
            mine.append(seen[k])
        parts.append(mine)
    label = np.array([y for _, y in docs])
    held = np.zeros((2, len(texts)))
    for mine, y in zip(parts, label, strict=True):
        held[int(y), list(set(mine))] += 1
    # Some labels are wrong: a passage is harmless unless it is several times as frequent in marked documents.
    harmless = (held[0] > 0) & (held[1] / max(1, label.sum()) < odds * held[0] / max(1, (1 - label).sum()))
    marked = [np.array(sorted(set(m))) for m, y in zip(parts, label, strict=True) if y and m]
    sure = (held[1] >= 3) & (held[1] / max(1, label.sum()) >= 2 * odds * held[0] / max(1, (1 - label).sum()))
    weights, bias = np.zeros(FEATURES, np.float32), 0.0
    if not marked or not harmless.any():
        return weights, -1.0
    chosen = np.unique(np.concatenate([m[~harmless[m]] for m in marked]))
    clean = np.flatnonzero(harmless)
    score = np.zeros(len(texts), np.float32)
    for turn in range(rounds):
        if not len(chosen):
            break
        hard = clean[score[clean] < 1.0] if turn else clean
        hard = hard[np.argsort(-(score[hard] + rng.normal(0, 0.05, len(hard))))][: negatives // 2]
        rest = rng.permutation(np.setdiff1d(clean, hard))[: negatives - len(hard)]
        pos = chosen if len(chosen) <= negatives // 2 else rng.choice(chosen, negatives // 2, replace=False)
        neg = np.concatenate([hard, rest])
        pool = np.concatenate([pos[sure[pos]], rng.permutation(pos[~sure[pos]])])[: 3 * landmarks // 2]
        marks = np.concatenate([pool[_spread([texts[i] for i in pool], landmarks // 2)], hard[: landmarks // 4], rng.permutation(rest)[: landmarks // 4]])
        use = [texts[i] for i in np.concatenate([pos, neg])]
        mark_rows = _feature_rows([texts[i] for i in marks])
        knm = _kernel(use, mark_rows, len(marks))
        kmm = _kernel([texts[i] for i in marks], mark_rows, len(marks)).astype(np.float64)
        scale = 1 / max(float(np.mean(np.diag(kmm))), 1e-9)
        lam, vec = np.linalg.eigh((kmm + kmm.T) / 2 * scale)
        good = lam > max(lam[-1] * 1e-5, 1e-9)
        root = vec[:, good] / np.sqrt(lam[good])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        # The first round's marks are mostly wrong, and are only followed where many agree.
        v = _squared_hinge((knm * scale) @ root, y, (cost if turn else first_cost) * np.sqrt(np.minimum(16, held.max(0))[np.concatenate([pos, neg])]))
        alpha = root @ v[:-1] * scale
        weights = np.bincount(mark_rows[1], alpha[mark_rows[0]] * mark_rows[2], FEATURES).astype(np.float32)
        weights[0] = 0
        bias = float(v[-1])
        score = np.concatenate([score_texts(texts[i : i + 5000], weights, bias) for i in range(0, len(texts), 5000)])
        kept = []
        for m in marked:
            s = np.where(harmless[m], -9.0, score[m])
            best = s.max()
            if turn == 0 or best > -0.5 or sure[m].any():
                kept.append(m[((s == best) & ((turn > 0) | ~sure[m].any()) & (s > -9)) | ((s > 0.0) & (turn > 0)) | sure[m]])
        chosen = np.unique(np.concatenate(kept)) if kept else np.zeros(0, int)
    return weights, bias


def labelled_documents(documents: DataFrame, labels: DataFrame, most: int = 4000, seed: int = 8) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled documents of each label, chosen by a hash of the id; documents whose raters
    disagree, or that have only null labels or no text, are left out."""
    agreed = labels.where("abusive IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("abusive").alias("y"), F.max("abusive").alias("y2")).where("y = y2").select("doc_id", "y")
    drawn = None
    for y in (0, 1):
        part = agreed.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y").collect()
    return [(r["text"], int(r["y"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which held-out documents agree best with their labels, by F1. Some labels are wrong, so cuts within half a
    standard error of the best F1 are as good; of these the one in the widest gap between scores is taken, at its middle."""
    order = np.argsort(-scores, kind="stable")
    down = scores[order]
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    best = float(f1.max())
    gap = down - np.append(down[1:], down[-1] - 1e-3)
    k = int(np.argmax(np.where(f1 >= best - np.sqrt(best * (1 - best) / max(1, y.sum())) / 2, gap, -1)))
    return float(down[k] - gap[k] / 2)


def document_score(text: str | None, weights: np.ndarray, bias: float) -> float:
    s = score_texts(passages(text), weights, bias)
    return float(s.max()) if len(s) else -10.0


def score_documents(documents: DataFrame, labels: DataFrame, most: int = 4000, held_out: float = 0.25) -> DataFrame:
    """(doc_id, source, score, abusive) of every document: the highest score of its passages, and whether that reaches
    the threshold. Whole texts are scored; null and empty texts get -10 and are not abusive. Without labels of both kinds
    nothing is abusive. The machine is trained on at most `most` labelled documents of each label, the threshold set on the
    `held_out` part of them; its 4 MB of weights are the same size for any corpus and go to the executors as a broadcast."""
    sc = documents.sparkSession.sparkContext
    docs = labelled_documents(documents, labels, most)
    order = np.random.default_rng(5).permutation(len(docs))
    cut = int(len(docs) * held_out)
    apart = [docs[i] for i in order[:cut]]
    weights, bias = fit([docs[i] for i in order[cut:]])
    marks = np.array([y for _, y in apart], int)
    at = threshold(np.array([document_score(t, weights, bias) for t, _ in apart]), marks) if weights.any() and marks.any() else 0.0
    shared = sc.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 400):
                batch = whole.slice(lo, 400)
                parts = [passages(t) for t in batch.column("text").to_pylist()]
                count = np.array([len(p) for p in parts])
                flat = score_texts([p for x in parts for p in x], w, bias)
                score = np.full(len(parts), -10.0)
                some = count > 0
                if some.any():
                    score[some] = np.maximum.reduceat(flat, np.concatenate([[0], np.cumsum(count[some])[:-1]]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(score), pa.array(score >= at)], names=["doc_id", "source", "score", "abusive"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double, abusive boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive documents and their rate per source; null is a source of its own."""
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"))
