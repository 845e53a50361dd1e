"""Plain re-statements of the definitions, one value at a time, to hold the operators against."""

import math
from fractions import Fraction


def auroc(pairs):
    pos, neg = [s for s, c in pairs if c], [s for s, c in pairs if not c]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def auc_nt(pairs):
    errors = sum(not c for _, c in pairs)
    if errors in (0, len(pairs)):
        return None
    ordered = sorted(pairs, key=lambda p: p[0])
    return sum(sum(not c for _, c in ordered[: k + 1]) / (k + 1) for k, (_, c) in enumerate(ordered) if not c) / errors


def ece(pairs):
    total = 0
    for b in range(10):
        own = [(s, c) for s, c in pairs if b / 10 < s <= (b + 1) / 10 or b == 0 and s == 0]
        if own:
            total += abs(sum(s for s, _ in own) - sum(c for _, c in own)) / len(pairs)
    return total


def nce(pairs):
    base = sum(c for _, c in pairs) / len(pairs)
    if base in (0, 1):
        return None
    clip = lambda s: min(max(s, 1e-15), 1 - 1e-15)
    model = -sum(math.log(clip(s) if c else 1 - clip(s)) for s, c in pairs) / len(pairs)
    prior = -base * math.log(base) - (1 - base) * math.log(1 - base)
    return 1 - model / prior


def curve(pairs):
    ordered = sorted(pairs, key=lambda p: -p[0])
    return [sum(not c for _, c in ordered[: k + 1]) / (k + 1) for k in range(len(ordered))]


def threshold(pairs, risk):
    best = (None, 0.0, 0.0)
    for t in sorted({s for s, _ in pairs}, reverse=True):
        kept = [c for s, c in pairs if s >= t]
        r = sum(not c for c in kept) / len(kept)
        if r <= risk:
            best = (t, len(kept) / len(pairs), r)
    return best


def isotonic(pairs, smooth):
    """Knots, by the min-max form of the fit on exact fractions."""
    ordered = sorted(pairs, key=lambda p: p[0])
    ys = [int(c) for _, c in ordered]
    n = len(ys)
    sums = [0]
    for y in ys:
        sums.append(sums[-1] + y)
    fitted = [max(min(Fraction(sums[k + 1] - sums[i], k + 1 - i) for k in range(t, n)) for i in range(t + 1)) for t in range(n)]
    knots = []
    for t, f in enumerate(fitted):
        own = fitted.count(f)
        y = (f * own + 1) / (own + 2) if smooth else f
        if knots and abs(knots[-1][1] - y) < 1e-12:
            knots[-1] = (ordered[t][0], knots[-1][1])
        else:
            knots.append((ordered[t][0], y))
    return [(x, float(y)) for x, y in knots]


def predict(knots, score):
    """Linear between knots; at or below the first x the first knot counts, at or above the last x the last, else of equal x the last."""
    if score <= knots[0][0]:
        return knots[0][1]
    if score >= knots[-1][0]:
        return knots[-1][1]
    at = max(i for i, (x, _) in enumerate(knots) if x <= score)
    (x0, y0), (x1, y1) = knots[at], knots[at + 1]
    return y0 + (y1 - y0) * (score - x0) / (x1 - x0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]
