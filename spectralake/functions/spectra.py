"""Kernels of the spectrum search: greedy matching, pool scores, gates, ranks and the penalty for shared chain peaks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


# Half-saturation of the primary and other pools, weights of pools, excluded mass around the precursor, factors.
PRIMARY, SECONDARY, CLUSTER, SHARED, IDENTICAL, TIE = 0.10, 0.05, 4.1, 0.5, 0.5, 1e-9
WEIGHTS = {"fah": 60.0, "hg": 20.0, "other": 20.0}
HG_FIRST = {"fah": 20.0, "hg": 60.0, "other": 20.0}
CLASS_WEIGHTS = {"SM": HG_FIRST, "LPC": HG_FIRST, "LPE": HG_FIRST, "ADGGA": HG_FIRST}
RAW_CLASSES = ("FA", "OXFA", "NAE")
TRIPLE = ("TG", "TGO", "TGEST")


def class_key(name: str) -> str:
    return "".join(c for c in (name or "").upper() if c.isascii() and c.isalnum())


def greedy(peaks: np.ndarray, relative: np.ndarray, masses: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """(fragment, peak): each fragment in stored order takes the most intense unused peak inside its window, the first of equals."""
    lo, hi = np.searchsorted(peaks, masses - windows, "left"), np.searchsorted(peaks, masses + windows, "right")
    used: set[int] = set()
    out = []
    for f in np.flatnonzero(hi > lo).tolist():
        best = -1
        for p in range(lo[f], hi[f]):
            if p not in used and (best < 0 or relative[p] > relative[best]):
                best = p
        if best >= 0:
            used.add(best)
            out.append((f, best))
    return out


def saturation(x: float, half: float) -> float:
    x = min(max(x, 0.0), 1.0)
    return min((1 + half) * x / (x + half), 1.0) if x > 0 else 0.0


@dataclass
class Record:
    """A library record prepared for scoring: fragment masses, pools, chains (token or ''), kinds."""

    number: int
    name: str
    chain_name: str
    kind: str
    adduct: str
    mz: float
    masses: np.ndarray
    names: list
    types: list
    pools: list
    chains: list
    #: expected chains with their multiplicity
    tokens: dict
    quality: int = 1
    plan: list = field(default_factory=list)
    #: evidence program of the rule that the record is under: branches of (mask, least); None without a rule
    program: list | None = None

    def prepare(self) -> Record:
        """(pool, fragments, weight, half-saturation, quality kind) of each pool: weights are shared among pools with fragments, and
        the only structural pool takes the larger structural weight."""
        key = class_key(self.kind)
        weights = dict(CLASS_WEIGHTS.get(key, WEIGHTS))
        counts = {p: self.pools.count(p) for p in weights}
        active = [p for p in weights if counts[p]]
        structural = [p for p in ("fah", "hg") if counts.get(p)]
        if len(structural) == 1:
            weights[structural[0]] = max(weights["fah"], weights["hg"])
        total = sum(weights[p] for p in active)
        first = max(structural, key=lambda p: weights[p], default=None)
        for p in weights:
            share = weights[p] / total * 100 if counts[p] and total > 0 else 100.0 / len(active) if counts[p] else 0.0
            kind = 0 if p == "other" else self.quality if p == "fah" else 1
            self.plan.append((p, counts[p], share, PRIMARY if p == first else SECONDARY, kind))
        return self


@dataclass
class Alike:
    """Records by mass with codes of their signatures (-1: none) and the masses of all their chain fragments, end to end."""

    codes: np.ndarray
    chains: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, records: list[Record], codes: np.ndarray) -> Alike:
        own = [r.masses[[bool(c) for c in r.chains]] for r in records]
        return cls(np.asarray(codes), np.concatenate([np.empty(0), *own]), np.concatenate([[0], np.cumsum([len(m) for m in own])]).astype(int))

    def kept(self, peaks: np.ndarray, precursor: float, masses: np.ndarray, lo: int, hi: int, ppm: float) -> list[int]:
        """Of records ``lo`` to ``hi`` those to score: all with a peak near a chain fragment, of the others the first and the nearest of a code."""
        codes = self.codes[lo:hi]
        if not (codes >= 0).any():
            return list(range(lo, hi))
        ends = self.ends[lo : hi + 1]
        m = self.chains[ends[0] : ends[-1]]
        width = np.abs(m) * ppm * 1e-6
        met = np.concatenate([[0], np.cumsum(np.searchsorted(peaks, m + width, "right") > np.searchsorted(peaks, m - width, "left"))])
        codes = np.where(met[ends[1:] - ends[0]] == met[ends[:-1] - ends[0]], codes, -1)
        error = np.abs((precursor - masses[lo:hi]) / masses[lo:hi] * 1e6)
        stay = codes < 0
        for by in (np.arange(len(codes)), error):
            # the sort is stable: of equal errors the earlier record
            row = np.lexsort((by, codes))
            stay[row[np.flatnonzero(np.diff(codes[row], prepend=-2) != 0)]] = True
        return (lo + np.flatnonzero(stay)).tolist()


@dataclass
class Hit:
    record: Record
    matches: list
    levels: list
    ppm: float
    pools: dict = field(default_factory=dict)
    score: float = 0.0
    missing: list = field(default_factory=list)
    resolution: str = "class_level"
    reason: str = ""
    demoted: bool = False
    uses: dict = field(default_factory=dict)

    def count(self) -> int:
        """Matches, chains as often as the name has them; three equal chains count once."""
        r = self.record
        if len(r.tokens) == 1 and sum(r.tokens.values()) == 3:
            return len(self.matches)
        return sum(r.tokens.get(r.chains[f], 1) for f, _ in self.matches)


def pool_quality(hit: Hit, pool: str, total: int, half: float, kind: int, levels: list[float]) -> float:
    """0: share of up to three supporting fragments; 1: the best; 2: mean of the two best peaks; 3: mean of the best half of three chains."""
    r = hit.record
    own = [(f, p, levels[i]) for i, (f, p) in enumerate(hit.matches) if r.pools[f] == pool]
    if kind == 0:
        return min(len(own) / min(total, 3), 1.0) if total else 0.0
    if kind == 1:
        return max((saturation(x, half) for _, _, x in own), default=0.0)
    best: dict = {}
    for f, p, x in own:
        key = p if kind == 2 else r.chains[f]
        if kind == 2 or key in r.tokens:
            best[key] = max(best.get(key, 0.0), saturation(x, half))
    top = sorted(best.values(), reverse=True)
    if kind == 2:
        return sum(top[:2]) / 2
    if not r.tokens:
        return 0.0
    if len(r.tokens) == 1 and sum(r.tokens.values()) == 3:
        return (top[0] * (1 + IDENTICAL) if top else 0.0) / 2
    n = min(2, len(r.tokens))
    return sum(top[:n]) / n


def rescore(hit: Hit, levels: list[float]) -> None:
    hit.pools = {p: share * pool_quality(hit, p, n, half, kind, levels) for p, n, share, half, kind in hit.record.plan}
    total = min(100.0, max(0.0, sum(hit.pools.values())))
    if class_key(hit.record.kind) == "CER" and not hit.record.adduct.endswith("+") and len(hit.matches) >= 10:
        total = min(100.0, total + 10)
    hit.score = round(total, 4)


def levels_of(mz: np.ndarray, intensity: np.ndarray, relative: np.ndarray, precursor: float, record: Record, matches: list) -> list[float]:
    """Relative intensities of the matched peaks; beyond the precursor's cluster over the base peak there, where that is more."""
    far = np.abs(mz - precursor) > CLUSTER
    base = float(intensity[far].max()) if far.any() else 0.0
    raw = class_key(record.kind) in RAW_CLASSES or base <= 0
    out = []
    for f, p in matches:
        level = float(relative[p])
        if not raw and record.types[f] != "Precursor Ion" and far[p]:
            level = max(level, min(float(intensity[p]) / base, 1.0))
        out.append(level)
    return out


def admitted(program: list, places) -> bool:
    """Whether matched fragments, by place, meet a program."""
    mask = 0
    for i in places:
        mask |= 1 << int(i)
    return any(all((bits & mask).bit_count() >= least for bits, least in branch) for branch in program)


def evaluate(mz: np.ndarray, intensity: np.ndarray, relative: np.ndarray, precursor: float, record: Record, ppm: float) -> Hit | None:
    """Match, gates, pools and resolution of one candidate; None without a match."""
    only = [i for i, t in enumerate(record.types) if t == "Precursor Ion"] if class_key(record.kind) in ("FA", "NAE") else None
    masses = record.masses if only is None else record.masses[only]
    if record.program is not None:
        # fragments with any peak in reach bound those that can be matched: most candidates end here
        width = np.abs(masses) * ppm * 1e-6
        if not admitted(record.program, np.flatnonzero(np.searchsorted(mz, masses + width, "right") > np.searchsorted(mz, masses - width, "left"))):
            return None
    matches = greedy(mz, relative, masses, np.abs(masses) * ppm * 1e-6)
    if only is not None:
        matches = [(only[f], p) for f, p in matches]
    if not matches:
        return None
    hit = Hit(record, matches, levels_of(mz, intensity, relative, precursor, record, matches), (precursor - record.mz) / record.mz * 1e6)
    rescore(hit, hit.levels)
    if only is not None:
        hit.resolution = "chain_level"
        return hit
    if record.program is not None:
        if not admitted(record.program, [f for f, _ in matches]):
            hit.missing.append("sphingo_rule")
            hit.reason = "sphingo_rule_failed"
        elif class_key(record.kind) == "SM" and record.adduct == "[M+Na]+":
            hit.resolution, hit.reason = "species_level", "headgroup_losses_only"
        elif class_key(record.kind) not in ("SPB", "LSM") and re.fullmatch(rf"{re.escape(record.kind)}\([mdt]?\d+:\d+\)", record.chain_name):
            hit.resolution, hit.reason = "species_level", "sum_composition_identity"
        else:
            hit.resolution = "chain_level"
        return hit
    found = {record.pools[f] for f, _ in matches}
    chains = {record.chains[f] for f, _ in matches} & set(record.tokens)
    positive = record.adduct.endswith("+")
    if "hg" in record.pools:
        n = record.pools.count("hg")
        asked = 1 if positive else max(1, -(-n // 2))
        if sum(record.pools[f] == "hg" for f, _ in matches) < min(n, asked):
            hit.missing.append("hg")
    if "fah" in record.pools and ("fah" not in found or (not positive and chains != set(record.tokens))):
        hit.missing.append("fah")
    if hit.missing:
        hit.reason = "missing_required_" + ",".join(hit.missing)
    elif not record.tokens:
        hit.resolution, hit.reason = "species_level", "missing_chain_annotation"
    elif chains == set(record.tokens):
        hit.resolution = "chain_level"
    else:
        hit.resolution, hit.reason = "species_level", "missing_chain_level_information"
    return hit


def order(hits: list[Hit]) -> list[Hit]:
    """Stable, by score, matches and nearness in mass."""
    near = lambda h: max(0.0, 1 - min(abs(h.ppm), 10.0) / 10)
    return sorted(hits, key=lambda h: (h.score / 100, len(h.matches), near(h)), reverse=True)


def reranked(hits: list[Hit], least: float) -> list[Hit]:
    """The top tier as it is; then, tier by tier, the others rescored: each selected candidate halves the strongest chain peak shared
    with it, over and over; what falls below ``least`` goes."""
    ordered = order(hits)
    if not ordered:
        return []
    top = [h for h in ordered if abs(h.score - ordered[0].score) <= TIE]
    most: dict = {}
    for h in top:
        most[class_key(h.record.kind)] = max(most.get(class_key(h.record.kind), 0), h.count())
    for h in top:
        h.demoted = h.count() < most[class_key(h.record.kind)]
    chosen = [h for h in top if not h.demoted]
    taken = {id(h) for h in chosen}
    rest = [h for h in ordered if id(h) not in taken]
    chain = {id(h): [i for i, (f, _) in enumerate(h.matches) if h.record.chains[f]] for h in ordered}
    new = chosen
    while rest:
        for group in ({h.matches[i][1] for i in chain[id(h)]} for h in new):
            for h in rest if group else ():
                shared = [i for i in chain[id(h)] if h.matches[i][1] in group]
                if shared:
                    one = max(shared, key=lambda i: h.levels[i])
                    h.uses[one] = h.uses.get(one, 0) + 1
        for h in rest:
            if h.uses:
                rescore(h, [x * SHARED ** h.uses.get(i, 0) for i, x in enumerate(h.levels)])
        rest = order([h for h in rest if h.score >= least])
        if rest:
            new = [h for h in rest if abs(h.score - rest[0].score) <= TIE]
            chosen = chosen + new
            taken = {id(h) for h in new}
            rest = [h for h in rest if id(h) not in taken]
    return chosen


def next_rank(hit: Hit, rank: int, before: Hit | None) -> int:
    if rank <= 0 or before is None:
        return 1
    tied = abs(hit.score - before.score) <= TIE
    if rank == 1 and (hit.demoted or (tied and class_key(hit.record.kind) == class_key(before.record.kind) and hit.count() != before.count())):
        return 2
    return rank if tied else rank + 1


def secondary(hit: Hit) -> bool:
    """Head group and a chain are matched, and the strongest of them has 5 %."""
    r = hit.record
    if sum(r.tokens.values()) <= 1:
        return False
    pools = {r.pools[f] for f, _ in hit.matches}
    strong = max((hit.levels[i] for i, (f, _) in enumerate(hit.matches) if r.pools[f] in ("fah", "hg")), default=0.0)
    return ("hg" in pools if "hg" in r.pools else r.adduct.endswith("+")) and any(r.chains[f] for f, _ in hit.matches) and strong >= 0.05


def reported(hits: list[Hit]) -> list[Hit]:
    """One hit for each reported identity: by resolution, score, matches and error, the first of equals."""
    level = {"chain_level": 3, "species_level": 2}
    best: dict = {}
    for h in hits:
        r = h.record
        name = r.chain_name if h.resolution == "chain_level" else r.name
        key, rank = (class_key(r.kind), r.adduct, name), (level.get(h.resolution, 0), h.score, len(h.matches), -abs(h.ppm))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, h)
    return [h for _, h in best.values()]


def search(mz: np.ndarray, intensity: np.ndarray, precursor: float, records: list[Record], ppm: float, top: int, least: float) -> list[tuple[Hit, int, str]]:
    """(hit, rank, scope) of one spectrum: peaks are normalised, candidates scored, main results reranked and selected."""
    if not len(mz) or intensity.max() <= 0:
        return []
    sort = np.argsort(mz, kind="stable")
    mz, intensity = mz[sort], intensity[sort]
    relative = intensity / intensity.max()
    hits = [h for r in records if (h := evaluate(mz, intensity, relative, precursor, r, ppm)) is not None and h.score >= least and not h.missing]
    out = []
    for scope in ("main", "fa", "nae"):
        own = [h for h in hits if {"FA": "fa", "NAE": "nae"}.get(class_key(h.record.kind), "main") == scope]
        rank, before, taken, capped = 0, None, 0, 0
        if scope != "main":
            chosen = order(own)[: max(1, top)]
        else:
            chosen = []
            for h in reranked(reported(own), least):
                new = next_rank(h, rank, before)
                if taken >= top and new != rank:
                    break
                if before is None or new == rank or secondary(h):
                    taken += 1
                    capped += class_key(h.record.kind) == "TGEST"
                    if class_key(h.record.kind) != "TGEST" or capped <= min(top, 3):
                        chosen.append(h)
                rank, before = new, h
        rank, before = 0, None
        for h in chosen:
            rank = next_rank(h, rank, before)
            before = h
            out.append((h, rank, scope))
    return out
