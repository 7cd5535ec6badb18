"""Plain-Python versions of the public metric definitions (SQuAD normalisation
and F1, multiset overlap, ROUGE-N, LCS, corpus BLEU) used as test oracles."""

import math
import re
import string
from collections import Counter


def normalize_answer(s):
    s = s.lower()
    s = "".join(ch for ch in s if ch not in set(string.punctuation))
    s = re.sub(r"\b(a|an|the)\b", " ", s, flags=re.UNICODE)
    return " ".join(s.split())


def get_tokens(s):
    return normalize_answer(s).split() if s else []


def f1_agree(gold, pred):
    g, p = get_tokens(gold), get_tokens(pred)
    same = sum((Counter(g) & Counter(p)).values())
    if not g or not p:
        return float(g == p)
    if same == 0:
        return 0.0
    pr, rc = same / len(p), same / len(g)
    return 2 * pr * rc / (pr + rc)


def f1_zero(pred, gold):
    p, g = normalize_answer(pred).split(), normalize_answer(gold).split()
    same = sum((Counter(p) & Counter(g)).values())
    if same == 0:
        return 0.0
    pr, rc = same / len(p), same / len(g)
    return 2 * pr * rc / (pr + rc)


def rouge_tokens(s):
    return re.findall(r"[a-z0-9]+", s.lower())


def ngrams(toks, n):
    return [tuple(toks[i:i + n]) for i in range(len(toks) - n + 1)]


def rouge_n(pred, ref, n):
    p, r = ngrams(rouge_tokens(pred), n), ngrams(rouge_tokens(ref), n)
    o = sum((Counter(p) & Counter(r)).values())
    pr, rc = o / max(len(p), 1), o / max(len(r), 1)
    return 2 * pr * rc / (pr + rc) if pr + rc > 0 else 0.0


def lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def corpus_bleu(preds, refs, max_order=4):
    matches, possible = [0] * max_order, [0] * max_order
    tl = rl = 0
    for p, r in zip(preds, refs):
        tl += len(p)
        rl += len(r)
        for n in range(1, max_order + 1):
            ov = Counter(ngrams(p, n)) & Counter(ngrams(r, n))
            matches[n - 1] += sum(ov.values())
            if len(p) - n + 1 > 0:
                possible[n - 1] += len(p) - n + 1
    precs = [m / c if c > 0 else 0.0 for m, c in zip(matches, possible)]
    geo = math.exp(sum(math.log(x) for x in precs) / max_order) if min(precs) > 0 else 0.0
    ratio = tl / rl
    bp = 1.0 if ratio > 1.0 else math.exp(1 - 1 / ratio)
    return geo * bp


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def lcs_ref_indices(ref, can):
    t = lcs_table(ref, can)
    i, j, out = len(ref), len(can), []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.insert(0, i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _fm(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_l(pred, ref):
    p, r = rouge_tokens(pred), rouge_tokens(ref)
    if not p or not r:
        return 0.0
    lcs = lcs_dp(p, r)
    return _fm(lcs / len(p), lcs / len(r))


def rouge_lsum(pred, ref):
    ps = [rouge_tokens(s) for s in pred.split("\n") if len(s)]
    rs = [rouge_tokens(s) for s in ref.split("\n") if len(s)]
    m, n = sum(map(len, rs)), sum(map(len, ps))
    if not rs or not ps or not m or not n:
        return 0.0
    cr, cp = Counter(), Counter()
    for s in rs:
        cr.update(s)
    for s in ps:
        cp.update(s)
    hits = 0
    for r in rs:
        union = sorted(set().union(*[lcs_ref_indices(r, c) for c in ps]))
        for i in union:
            tok = r[i]
            if cp[tok] > 0 and cr[tok] > 0:
                hits += 1
                cp[tok] -= 1
                cr[tok] -= 1
    return _fm(hits / n, hits / m)
