"""Identification of one query, one fingerprint after another: a slow statement of what the plans must return."""

from collections import defaultdict

import numpy as np

from tonemark import params as P


def channel(f):
    return (f - P.K_MIN + 1) // 9


def units(a, b, unit):
    return int(np.float32(np.float32(b) / np.float32(unit)) - np.float32(np.float32(a) / np.float32(unit)))


def pair_term(a, b):
    return a["w"] << 19 | (a["f"] // 186) << 17 | b["w"] << 10 | units(a["t"], b["t"], 5.0) << 6 | units(a["f"], b["f"], 9.0) & 63


def followers(seq, k):
    n = 0
    for j in range(k + 1, len(seq)):
        if seq[j]["t"] - seq[k]["t"] > P.PAIR_FRAMES or n == P.PAIRS:
            return
        if seq[j]["f"] // 186 == seq[k]["f"] // 186:
            n += 1
            yield j


def build(recordings, kind):
    lists = defaultdict(lambda: defaultdict(list))
    for fid, seq in recordings.items():
        for k, x in enumerate(seq):
            terms = [x["w"] << 6 | channel(x["f"])] if kind == "MSCALE" else [pair_term(x, seq[j]) for j in followers(seq, k)]
            for term in terms:
                item = (k, x["t"], x["e"])
                if not lists[term][fid] or lists[term][fid][-1] != item:
                    lists[term][fid].append(item)
    return lists


class Bin:
    def __init__(self):
        self.score = self.order = self.last_t = 0
        self.info, self.scored = {}, False


class Matcher:
    def __init__(self, recordings, kind="MSCALE", mms=0.5):
        self.rec, self.kind, self.mms, self.lists = recordings, kind, mms, build(recordings, kind)
        self.x, self.done, self.acc, self.cue, self.top = [], 0, defaultdict(int), {}, []

    def candidates(self, lo, hi):
        histos = defaultdict(lambda: defaultdict(Bin))
        best = {}
        used = set()
        for k in range(lo, hi):
            terms = [self.x[k]["w"] << 6 | channel(self.x[k]["f"])] if self.kind == "MSCALE" else [pair_term(self.x[k], self.x[j]) for j in followers(self.x, k)]
            for term in terms:
                if term in used:
                    continue
                used.add(term)
                for fid, items in self.lists.get(term, {}).items():
                    h = histos[fid]
                    for lid, t, e in items:
                        b = h[t // P.BIN]
                        if b.scored:
                            continue
                        owner = b.info.setdefault(lid, k)
                        if owner != k or (self.kind == "MSCALE" and lid in b.__dict__.setdefault("seen", set())):
                            continue
                        b.__dict__.setdefault("seen", set()).add(lid)
                        d = t - b.last_t
                        d = 0 if abs(d) <= 2 else d
                        b.score += int(np.float32(1000) * (np.float32(1) - np.float32(abs(self.x[k]["e"] - e)) / np.float32(720)))
                        if d >= 0:
                            b.order += 1
                            b.score += 1000 * b.order // len(b.info)
                        b.last_t, b.scored = t, True
                        if fid not in best or b.score > h[best[fid]].score:
                            best[fid] = t // P.BIN
                    for b in h.values():
                        b.scored = False
        top = defaultdict(list)
        for fid in sorted(best):
            score = histos[fid][best[fid]].score
            if score > P.MIN_SCORE and len(top[score]) < P.TIES[self.kind]:
                top[score].append(fid)
        keep = sorted((s for s in top if top[s]), reverse=True)[: P.TOP_K]
        return [(s, fid, best[fid], histos[fid]) for s in keep for fid in top[s]]

    def graph(self, seq, lo, hi, ref):
        q = lambda v, unit: (2 * v + unit) // (2 * unit)
        out = {}
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                a, b, c = seq[i], seq[j], seq[ref]
                key = tuple(v & 255 for v in (q(b["t"], 5) - q(a["t"], 5), q(b["f"], 9) - q(a["f"], 9), q(c["t"], 5) - q(a["t"], 5), q(c["f"], 9) - q(a["f"], 9)))
                out[key] = (a, b)
        return out

    def rerank(self, found):
        for _, fid, _, h in found:
            seq, top_score = self.rec[fid], 0
            for b in sorted(h):
                if h[b].score <= 3000 or any(h[j].score > h[b].score for j in h if abs(j - b) <= 3):
                    continue
                bins = defaultdict(int)
                for lid, k in h[b].info.items():
                    if lid not in h[b].__dict__.get("seen", {lid}):
                        continue
                    left, right = min(k, 15), min(15, len(self.x) - 1 - k)
                    gx = self.graph(self.x, k - left, k + right, k)
                    gq = self.graph(seq, max(0, lid - left), min(len(seq) - 1, lid + right), lid)
                    for key, (a, c) in gq.items():
                        if key in gx:
                            s = 1000
                            for r, x in zip((a, c), gx[key], strict=True):
                                if r["w"] == x["w"]:
                                    s += 1000 * (720 - abs(r["e"] - x["e"])) // 720
                            bins[a["t"] // P.BIN] += s // 2
                            bins[c["t"] // P.BIN] += s // 2
                if bins:
                    most = max(bins.values())
                    self.acc[fid] += most
                    if most > top_score:
                        top_score = most
                        self.cue[fid] = min(x for x in bins if bins[x] == most)

    def batch(self, lo, hi):
        if self.kind == "XSCALE" and hi - lo < 2:
            return
        found = self.candidates(lo, hi)
        if found:
            scores = sorted({s for s, *_ in found}, reverse=True)
            conf = 2 * scores[0] / (scores[0] + (scores[1] if len(scores) > 1 else 0)) - 1
            if conf <= self.mms:
                self.rerank(found)
            else:
                for s, fid, b, _ in found:
                    self.acc[fid] += s
                    self.cue[fid] = b
            self.top = sorted(set(self.acc.values()), reverse=True)[: P.TOP_K]

    def process(self, lfs):
        self.x += lfs
        n = 0
        while len(self.x) - self.done >= P.BATCH:
            self.batch(self.done, self.done + P.BATCH)
            self.done += P.BATCH
            n += 1
        return n


def grade(x, pts, kind):
    if kind == "fall":
        return 1.0 if x <= pts[0] else max(0.0, (pts[1] - x) / (pts[1] - pts[0]))
    if kind == "rise":
        return 1.0 if x >= pts[1] else max(0.0, (x - pts[0]) / (pts[1] - pts[0]))
    a, b, c = pts
    return max(0.0, (x - a) / (b - a)) if x <= b else max(0.0, (c - x) / (c - b))


def classify(conf, time, mode="EASY"):
    c = P.FUZZY[mode]
    lo, me, hi = grade(conf, c["low"], "fall"), grade(conf, c["med"], "hill"), grade(conf, c["high"], "rise")
    sh, mi, lg = grade(time, c["short"], "fall"), grade(time, c["mid"], "hill"), grade(time, c["long"], "rise")
    u = [min(lo, lg), min(me, lg), max(min(hi, mi), min(hi, lg)), max(min(hi, sh), min(me, sh), min(me, mi), min(lo, sh), min(lo, mi))]
    return P.CLASSES[u.index(max(u))]


def identify(lfs, recordings, kind="MSCALE", dur=1.804088, mms=0.5, mode="EASY", flush=True):
    """(status, fids) of the first decision."""
    m = Matcher(recordings, kind, mms)
    sums, n_steps = defaultdict(float), defaultdict(int)
    clock = 0.0

    def classes(time, step_time):
        if not m.top:
            return []
        best = sorted(f for f, a in m.acc.items() if a == m.top[0])
        conf = m.top[0] / (m.top[0] + (m.top[1] if len(m.top) > 1 else 0))
        out = []
        for f in best:
            before = n_steps[f] * dur
            sums[f] += conf
            n_steps[f] += 1
            out.append((classify(sums[f] / n_steps[f], before + step_time if time < P.MAX_ID_TIME else time, mode), f))
        return out

    for block in range(max(x["block_no"] for x in lfs) + 1):
        clock += dur
        n = m.process([x for x in lfs if x["block_no"] == block])
        got = classes(clock, dur) if n and m.top else [(classify(0.0, clock, mode), None)]
        final = [(c, f) for c, f in got if c != "LISTENING"]
        if not final:
            continue
        if any(c != "UNIDENTIFIED" for c, _ in final):
            return "MATCH", sorted(f for c, f in final if c != "UNIDENTIFIED")
        if flush and len(m.x) - m.done >= 2:
            start = m.x[m.done - 1]["t"] if m.done else 0
            m.batch(m.done, len(m.x))
            final = [(c, f) for c, f in classes(clock, (m.x[-1]["t"] - start) * P.DT) if c in ("IDENTIFIED", "SOUNDS_LIKE")]
            if final:
                return "MATCH", sorted(f for _, f in final)
        return "NO_MATCH", []
    return "PENDING", []
