"""The controller: per fragment of speech, wait, search or suppress; and the engine's turns.

Everything is a pure step (state, event) -> (state, rows), so the same code runs over a whole
conversation in batch and over micro-batches in a stream. State is plain data that JSON can hold. It is
kept by session, as a refinement needs the session's earlier queries, and by utterance inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import exp
from typing import Any, NamedTuple

from evidora import config as C
from evidora.functions.numbers import spoken_numbers

_STOP, _DANGLING = frozenset(C.STOPWORDS), frozenset(C.DANGLING)
_CUES, _ANAPHORA, _LEADERS = frozenset(C.FORMAT_CUES), frozenset(C.ANAPHORA), frozenset(C.LEADING_VERBS)
_PLAIN = _STOP | _CUES | _ANAPHORA | frozenset(C.PRESENTATION_FILLER)
_SKIPPED = frozenset(C.SKIPPED_LEADERS)
_CHAT, _GREETING = frozenset(C.CHITCHAT_WORDS), frozenset(C.CHITCHAT_STRONG + C.CHITCHAT_WEAK)
_WH, _GOVERNING = frozenset(C.QUESTION_WORDS), frozenset(C.GOVERNING_WORDS)
_I = re.IGNORECASE
_BOUNDARY, _FILLER, _ARTICLE = re.compile(C.CLAUSE_BOUNDARY, _I), re.compile(C.LEAD_FILLER, _I), re.compile(C.ARTICLE_LEAD, _I)
_OPENER, _DISCOURSE, _REFINES = re.compile(C.QUESTION_START, _I), re.compile(C.DISCOURSE, _I), re.compile(C.REFINEMENT, _I)
_FORMAT = re.compile(C.QUANTIFIED_FORMAT, _I)
_QUESTION_END = re.compile(r"(?<=\?)[\s,]*(?:and\s+)?")


def content(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in _STOP]


def likeness(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _apostrophe_words(text: str) -> list[str]:
    return re.findall("[a-z0-9']+", text.lower())


def is_chit_chat(text: str) -> bool:
    words = set(_apostrophe_words(text))
    return bool(words) and words <= _CHAT and bool(words & _GREETING)


def is_presentation(text: str) -> bool:
    """A text that asks for another form of the last answer: all of a word for a form, no word of a topic, and
    something that refers back or orders the form."""
    words = _apostrophe_words(text.replace("TL;DR", "tldr").replace("tl;dr", "tldr"))
    found = set(words)
    topic = {w for w in found - _PLAIN if len(w) > 1 and not w.isdigit()}
    order = next((w for w in words if w not in _SKIPPED), "") in _LEADERS
    return not topic and bool(found & _CUES) and (order or bool(found & _ANAPHORA) or _FORMAT.search(text) is not None)


# -- clauses -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """A piece of an utterance with what decisions need of it."""

    said: str
    text: str
    tokens: tuple[str, ...]
    opens: bool  # begins like a question
    long: bool  # two content words or more as said

    @classmethod
    def of(cls, piece: str) -> Clause:
        said = piece.strip()
        text = _ARTICLE.sub("", _FILLER.sub("", said.strip(".,;:")).strip()).strip()
        return cls(said, text, tuple(content(text)), bool(_OPENER.match(said)), len(content(said)) > 1)


def _asks(words: list[str]) -> bool:
    """Whether a question word is among the words, or one up to the first content word opens a question."""
    lead = next((k + 1 for k, w in enumerate(words) if content(w)), len(words))
    return not _WH.isdisjoint(w.lower() for w in words) or any(_OPENER.match(w.lower()) for w in words[:lead])


def split_unpunctuated(text: str, least: int = 3) -> str:
    """Commas before question words that begin another question; texts with punctuation stay. A question begins
    anew after 'and', and another one where the words since are a question of ``least`` content words."""
    if re.search(r"[.?!,;:]", text):
        return text
    words = text.split()
    start, breaks = 0, set()
    for k, word in enumerate(words):
        own = words[start:k]
        if own and own[-1].lower() == "and":
            start = k
        elif word.lower() in _WH and sum(bool(content(w)) for w in own) >= least and own[-1].lower() not in _GOVERNING and _asks(own):
            start = k
            breaks.add(k)
    return " ".join(w + "," * (k + 1 in breaks) for k, w in enumerate(words))


def pieces(text: str) -> list[str]:
    """Cut at commas and the like; inside a question only where a question opens on both sides."""

    def cut(sentence: str, marks: list[tuple[int, int]], lo: int, both: bool) -> Iterator[str]:
        for k, (end, after) in enumerate(marks):
            if not both or all(_OPENER.match(x.strip()) for x in (sentence[lo:end], sentence[after:])):
                yield sentence[lo:end]
                yield from cut(sentence, marks[k + 1 :], after, both)
                return
        yield sentence[lo:]

    found = (x for x in _QUESTION_END.split(text) if x.strip())
    return [p for x in found for p in cut(x, [m.span() for m in _BOUNDARY.finditer(x)], 0, x.rstrip().endswith("?"))]


def clauses(text: str, least: int = 2) -> list[Clause]:
    """Fragments of too few words go, unless alone or questions."""
    found = [c for c in map(Clause.of, pieces(text)) if c.text]
    return [c for c in found if len(found) == 1 or c.opens or len(c.tokens) >= least]


@dataclass
class Query:
    query_id: str
    text: str
    label: str
    trigger: str
    clause: list[str]
    parent: str | None = None

    def words(self) -> set[str]:
        return set(self.clause) or set(content(self.text))


def read(text: str, own: C.Controller) -> str:
    """The text as the settings ask it to be read before it is cut."""
    steps = ((own.strip_markers, lambda x: _DISCOURSE.sub("", x.strip()).strip()), (own.spoken_numbers, spoken_numbers), (own.split_unpunctuated, split_unpunctuated))
    return reduce(lambda x, step: step[1](x) if step[0] else x, steps, text)


def decompose(text: str, covered: set[str], utterance: str, trigger: str, issued: int, own: C.Controller = C.Controller()) -> list[Query]:
    """New sub-queries of an utterance: clauses with words not yet covered and unlike their siblings, short ones
    with the topic of the first clause added."""
    found = clauses(read(text, own), own.min_clause_tokens)
    topic = found[0].tokens[: own.carry_tokens] if found else ()

    def lacks_topic(c: Clause) -> bool:
        return len(set(c.tokens)) < 4 if own.context_carry == "short" else not (c.opens and c.long)

    taken: list[Clause] = []
    for c in found:
        if not set(c.tokens) <= covered and all(likeness(set(c.tokens), set(t.tokens)) < own.merge for t in taken):
            taken.append(c)
    return [
        Query(
            query_id=f"{utterance}.q{issued + n}",
            text=" ".join([c.text, *(t for t in topic if lacks_topic(c) and t not in c.tokens)]),
            label=" ".join(c.tokens[:3]) or c.text[:30],
            trigger=trigger,
            clause=sorted(set(c.tokens)),
        )
        for n, c in enumerate(taken, 1)
    ]


# -- stability -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """What the corpus knows: discriminative terms and rare bigrams. Both are bounded by the caller."""

    terms: frozenset[str] = frozenset()
    bigrams: frozenset[str] = frozenset()


def anchors(text: str, known: Vocabulary) -> tuple[bool, bool, bool, bool]:
    """(strong, topic, bigram, weak)."""
    own = content(text)
    strong = bool(re.search(r"\b\d+\b", text)) or any(re.fullmatch("[A-Z][a-z]{2,}", w.strip(".,;:")) for w in text.split()[1:])
    topic = len(own) >= 2 and not known.terms.isdisjoint(own)
    pair = not known.bigrams.isdisjoint(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))
    return strong, topic, pair, len(own) >= 4


def mid_thought(text: str) -> bool:
    bare = text.strip().rstrip(",")
    if bare.endswith((".", "!", "?")):
        return False
    words = re.findall("[A-Za-z']+", bare)
    return not words or words[-1].lower() in _DANGLING


class Signals(NamedTuple):
    """What a score of stability is made of, in the order of the model's weights."""

    strong: float
    topic: float
    pair: float
    weak: float
    dangling: float
    settled: float
    tokens: float
    words: float
    asks: float
    ended: float

    @classmethod
    def of(cls, text: str, previous: str, known: Vocabulary) -> Signals:
        tokens, words = content(text), text.split()
        settled = bool(previous) and set(tokens) <= set(content(previous))
        asks = not _WH.isdisjoint(w.strip("?,.!;:").lower() for w in words[:3])
        return cls(*anchors(text, known), mid_thought(text), settled, min(len(tokens) / 8, 2.0), min(len(words) / 20, 2.0), asks, text.endswith("?"))

    def by_rules(self) -> float:
        anchor = max(0.5 * max(self.strong, self.topic, self.pair), 0.25 * self.weak)
        return min(1.0, anchor + 0.3 * (not self.dangling) + 0.2 * (self.settled or self.tokens >= 5 / 8))

    def by_model(self) -> float:
        z = C.STABILITY_BIAS + sum(w * x for w, x in zip(C.STABILITY_WEIGHTS, self, strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def stability(text: str, previous: str, final: bool, known: Vocabulary = Vocabulary(), own: C.Controller = C.Controller()) -> float:
    bare = text.strip()
    if final or not bare:
        return float(final)
    signals = Signals.of(bare, previous, known)
    return signals.by_model() if own.mode == "model" else signals.by_rules()


# -- the step ------------------------------------------------------------------------------------


@dataclass
class Utterance:
    text: str = ""
    covered: list[str] = field(default_factory=list)
    issued: int = 0
    live: list[Query] = field(default_factory=list)
    cancelled: list[str] = field(default_factory=list)
    kind: str = ""
    reason: str = ""
    heard: str = ""
    asked: list[str] = field(default_factory=list)
    ahead: list[str] = field(default_factory=list)


@dataclass
class Session:
    """answered: queries of earlier turns that ended with a search, the latest turn's last; requests: how many searches were
    started. An utterance's heard is its latest hypothesis, asked the texts searched, ahead those searched in advance."""

    open: dict[str, Utterance] = field(default_factory=dict)
    answered: list[Query] = field(default_factory=list)
    topic: str = ""
    requests: int = 0

    def to_json(self) -> dict[str, Any]:
        from dataclasses import asdict

        return asdict(self)

    @classmethod
    def of_json(cls, data: dict[str, Any]) -> Session:
        opened = {k: Utterance(**{**u, "live": [Query(**q) for q in u["live"]]}) for k, u in data["open"].items()}
        return cls(opened, [Query(**q) for q in data["answered"]], data["topic"], data["requests"])


@dataclass
class Decision:
    decision: str
    kind: str
    reason: str
    stability: float
    queries: list[Query] = field(default_factory=list)
    superseded: list[str] = field(default_factory=list)


def classify(text: str, session: Session, own: C.Controller = C.Controller()) -> str:
    if is_chit_chat(text):
        return "chit_chat"
    if is_presentation(text):
        return "presentation_only"
    if session.answered:
        words = set(content(text))
        near = len(words) <= own.refine_tokens and likeness(words, set(content(session.topic))) >= own.refine
        if _REFINES.search(text) or near:
            return "refinement"
    return "new_request"


def scoped(found: list[Query], session: Session, own: C.Controller) -> list[Query]:
    """Queries of a refinement that earlier ones don't answer, each with the one it is most like as parent."""
    out = []
    for q in found:
        words = set(content(q.text))
        ranked = [(likeness(words, set(content(p.text))), -k) for k, p in enumerate(session.answered)]
        best, at = max(ranked, default=(0.0, 0))
        if best < own.answered:
            q.trigger, q.parent = "refinement", session.answered[-at].query_id if best > 0 else None
            out.append(q)
    return out


def supersede(found: list[Query], u: Utterance, limit: float) -> list[str]:
    """A new clause that holds (nearly) all words of a live one replaces it, each at most one in order; others that any new
    clause holds are superseded too. Returns the latter; u.live is brought up to date."""

    def held(new: Query, old: Query) -> float:
        return len(new.words() & old.words()) / len(old.words()) if old.words() else 0.0

    for q in found:
        best, at = max(((held(q, p), -k) for k, p in enumerate(u.live)), default=(0.0, 0))
        if best >= limit:
            q.parent = u.live.pop(-at).query_id
    orphans = [p for p in u.live if any(held(q, p) >= limit for q in found)]
    u.live = [p for p in u.live if p not in orphans] + found
    return [p.query_id for p in orphans]


def decide(session: Session, utterance_id: str, fragment: str, final: bool, known: Vocabulary = Vocabulary(), own: C.Controller = C.Controller()) -> Decision:
    """Takes a fragment (or the end) of an utterance; changes the session."""
    u = session.open.setdefault(utterance_id, Utterance())
    previous, u.text = u.text, u.text + fragment
    text = u.text.strip()
    if not text and not final:
        return Decision("wait", "new_request", "empty_fragment", 0.0)
    kind = classify(text, session, own)
    if kind == "chit_chat":
        return Decision("suppress", kind, kind, 1.0)
    if kind == "presentation_only":
        return Decision("suppress", kind, "presentation_restructure" if session.answered else "presentation_without_answer", 1.0)
    score = stability(text, previous, final, known, own)
    partial = own.model_threshold if own.mode == "model" else own.partial_stability
    if score < (own.final_stability if final else partial):
        return Decision("wait", kind, "intent_unstable", score)
    trigger = "refinement" if kind == "refinement" else "final" if final else "provisional"
    found = decompose(text, set(u.covered), utterance_id, trigger, u.issued, own)
    if kind == "refinement":
        found = scoped(found, session, own)
    if not found:
        return Decision("wait", kind, "no_new_intent", score)
    if len(found) > 1 and kind != "refinement":
        for q in found:
            q.trigger = "multi_intent"
    orphans = supersede(found, u, own.supersede)
    u.covered = sorted(set(u.covered).union(*({*content(q.label), *content(q.text)} for q in found)))
    u.issued += len(found)
    u.cancelled += orphans + [q.parent for q in found if q.parent and q.parent.startswith(f"{utterance_id}.q")]
    return Decision("retrieve", kind, "refinement_delta" if kind == "refinement" else "multi_intent" if len(found) > 1 else "intent_stable", score, found, orphans)


def preview(session: Session, utterance_id: str, pending: str = "", known: Vocabulary = Vocabulary(), own: C.Controller = C.Controller()) -> list[Query]:
    """What would still be searched if ``pending`` came and the utterance ended; the session stays as it is."""
    trial = Session.of_json(session.to_json())
    first = decide(trial, utterance_id, pending, False, known, own).queries if pending else []
    return first + decide(trial, utterance_id, "", True, known, own).queries


def hypothesis_rest(committed: str, hypothesis: str) -> str | None:
    """What a hypothesis adds to the committed words; null unless it extends them exactly."""
    done, words = committed.split(), hypothesis.split()
    return " ".join(words[len(done) :]) if words[: len(done)] == done else None


def look_ahead(session: Session, utterance_id: str, known: Vocabulary, own: C.Controller) -> tuple[list[str], list[str]]:
    """(new, stale) texts to search in advance: what the end would ask now, and after the words that the hypothesis adds. Decisions
    and answers don't depend on them; a later query of the same text takes its result."""
    u = session.open.setdefault(utterance_id, Utterance())
    rest = hypothesis_rest(u.text, u.heard) if u.heard else None
    pending = [""] + ([" " * bool(u.text.strip()) + rest] if rest else [])
    wanted = dict.fromkeys(q.text for p in pending for q in preview(session, utterance_id, p, known, own) if q.text not in u.asked)
    new, stale = [t for t in wanted if t not in u.ahead], [t for t in u.ahead if t not in wanted]
    u.ahead = list(wanted)
    return new, stale


def degraded(session: Session, only: set[str] | None = None) -> list[dict[str, Any]]:
    """Turn rows of the utterances (all, or those named) that are given up before their end, whose searches are all cancelled."""
    return [
        {"row": "turn", "utterance_id": uid, "turn_kind": u.kind or "new_request", "reason": "degraded", "live": [], "cancelled": u.cancelled + [q.query_id for q in u.live], "retrieval_required": u.issued > 0}
        for uid, u in session.open.items()
        if only is None or uid in only
    ]


def step(session: Session, event: dict[str, Any], mode: str = "streaming", known: Vocabulary = Vocabulary(), own: C.Controller = C.Controller()) -> list[dict[str, Any]]:
    """One envelope event; rows (kind: decision, query or turn) for the log. A bad event gives an error row. Modes: 'streaming'
    decides at each fragment, 'deferred' at the end only, 'baseline' asks one query of the whole utterance."""
    kind, uid, ts = event.get("event_type"), event.get("utterance_id"), event.get("timestamp_ms")
    base = {"utterance_id": uid, "ts_ms": ts}
    if kind not in ("session_start", "session_end") and (uid is None or ts is None) or kind is None:
        return [base | {"row": "error", "reason": "malformed"}]
    if kind == "session_start":
        return []
    if kind == "session_end":
        session.open.clear()
        session.answered, session.topic = [], ""
        return []
    searching = mode == "streaming" and own.speculate

    def ahead() -> list[dict[str, Any]]:
        new, stale = look_ahead(session, uid, known, own)
        return [base | {"row": "prefetch_cancelled", "text": t} for t in stale] + [base | {"row": "prefetch", "text": t} for t in new]

    if kind == "transcript_hypothesis":  # may only bring work forward, never change an answer
        if not searching:
            return []
        session.open.setdefault(uid, Utterance()).heard = event.get("text") or ""
        return ahead()
    if kind not in ("transcript_chunk", "utterance_end"):
        return [base | {"row": "error", "reason": "unknown event type"}]
    final = kind == "utterance_end"
    fragment = "" if final else event.get("text") or ""
    if mode != "streaming" and not final:
        session.open.setdefault(uid, Utterance()).text += fragment
        return []
    if mode == "baseline":
        u = session.open.setdefault(uid, Utterance())
        text = u.text.strip()
        made = Decision("retrieve", "new_request", "baseline", 1.0, [Query(f"{uid}.q1", text, text[:30], "final", sorted(set(content(text))))] if text else [])
        u.live, u.issued = list(made.queries), len(made.queries)
    else:
        made = decide(session, uid, fragment, final, known, own)
    rows = [base | {"row": "decision", "decision": made.decision, "turn_kind": made.kind, "reason": made.reason, "stability": made.stability, "superseded": made.superseded}]
    u = session.open.setdefault(uid, Utterance())
    for q in made.queries:
        session.requests += 1
        rows.append(base | {"row": "query", "query_id": q.query_id, "text": q.text, "label": q.label, "trigger": q.trigger, "parent": q.parent, "request_id": f"r{session.requests}", "adopted": q.text in u.ahead})
        u.asked.append(q.text)
        u.ahead = [t for t in u.ahead if t != q.text]
    if made.decision != "wait" or not u.kind:  # waiting after a search never takes its place
        u.kind, u.reason = made.kind, made.reason
    if final:
        rows.append(base | {"row": "turn", "turn_kind": u.kind, "reason": u.reason, "live": [q.query_id for q in u.live], "cancelled": u.cancelled, "retrieval_required": u.issued > 0})
        if u.live:
            session.answered = (session.answered if u.kind == "refinement" else []) + u.live
            session.topic = "; ".join(q.label for q in session.answered[:3])
        del session.open[uid]
    elif searching:
        rows += ahead()
    return rows
