"""Settings of the engine, and the fixed word lists and patterns that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    sparse_weight: float = 0.5
    dense_weight: float = 0.5
    char_weight: float = 0.0
    k: int = 8
    mode: str = "hybrid"  # hybrid, dense or sparse
    reranker: str = "heuristic"  # heuristic, none or a scorer given by the caller
    rerank_pool: int = 20
    chunk_chars: int = 600
    overlap_sentences: int = 1
    min_idf: float = 2.5
    low_bigram_df: int = 5
    dedup: float = 0.8
    low_confidence: float = 0.15
    low_confidence_scorer: float = -5.0

    @property
    def pool(self) -> int:
        return max(4 * self.k, 20)


@dataclass(frozen=True)
class Controller:
    mode: str = "rule"  # rule or model
    partial_stability: float = 0.45
    final_stability: float = 0.6
    model_threshold: float = 0.39
    merge: float = 0.6
    carry_tokens: int = 4
    min_clause_tokens: int = 2
    supersede: float = 0.8
    answered: float = 0.75
    refine: float = 0.12
    refine_tokens: int = 12
    context_carry: str = "short"  # short or question
    strip_markers: bool = False
    spoken_numbers: bool = False
    split_unpunctuated: bool = False
    speculate: bool = False  # search ahead during speech what the end would ask


@dataclass(frozen=True)
class Answers:
    relevance: float = 0.2
    relevance_floor: float = 0.12
    relevance_step: float = 0.02
    support: float = 0.6
    merge: float = 0.45
    anaphoric_context: bool = False
    anaphoric_continuation: bool = False
    claim_threshold: float = -4.0


@dataclass(frozen=True)
class Speech:
    words_per_minute: int = 150
    words_per_chunk: int = 6
    end_pause_ms: int = 300


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    controller: Controller = field(default_factory=Controller)
    answers: Answers = field(default_factory=Answers)
    speech: Speech = field(default_factory=Speech)

    def override(self, path: str, value: object) -> Config:
        """A copy with the setting at a dotted path changed; text is turned into the setting's type."""
        from dataclasses import replace

        group, _, name = path.partition(".")
        own = getattr(self, group)
        old = getattr(own, name)
        if isinstance(value, str) and not isinstance(old, str):
            value = value.strip().lower() in ("1", "true", "yes", "on") if isinstance(old, bool) else type(old)(value)
        return replace(self, **{group: replace(own, **{name: value})})


# Results depend on these word lists and patterns being exactly these.
STOPWORDS = """
a an the and or but if then than that this these those of in on at to for from by with without
is are was were be been being am do does did doing have has had having i you he she it we they
me him her us them my your his its our their as so such not no nor can will would should could
about into over under again further once here there when where why how all any both each few more
most other some only own same too very s t just don now please need want
what who which whom whose
""".split()
DANGLING = """
in on at to for from by with about into over under of and or but the a an
my our your their its his her this that these those is are was were be been
i we you they he she it need want would like also plus including
""".split()
MODALS = "must may requires required shall cannot prohibited eligible".split()
FORMAT_CUES = """
repeat rephrase reword paraphrase summarize summarise summary shorten shorter short brief briefly
condense expand translate simplify simpler simply bullet bullets point points list table sentence
sentences line lines word words again tldr format reformat differently concise concisely wording
""".split()
LEADING_VERBS = """
repeat rephrase reword paraphrase summarize summarise shorten condense expand translate simplify
reformat format tldr
""".split()
ANAPHORA = "that it this these those them above previous last earlier answer response reply said".split()
LANGUAGES = """
english hindi spanish french german tamil telugu kannada malayalam marathi bengali gujarati punjabi urdu
korean japanese chinese mandarin arabic portuguese italian russian
""".split()
PRESENTATION_FILLER = """
please kindly can could would will you your me my give make put say tell show write now just into way
actually also and then ok okay well so one two three four five six seven eight nine ten
text version form style manner
""".split() + LANGUAGES
SKIPPED_LEADERS = "please kindly can could would will you now actually also and then ok okay well so just".split()
CHITCHAT_STRONG = "hi hello hey thanks thank thankyou cheers bye goodbye appreciate appreciated morning afternoon evening night".split()
CHITCHAT_WEAK = "ok okay great perfect cool awesome nice got".split()
CHITCHAT_WORDS = CHITCHAT_STRONG + CHITCHAT_WEAK + """
got it good morning afternoon evening night alright sure that's thats all for today now so very much
a lot you i'll see later talk soon take care helpful
""".split()
QUESTION_WORDS = "what who whom whose which when where why how".split()
GOVERNING_WORDS = """
in on at by for from of to with about upon into over under through during between among against
is was are were be been being am do does did know knows knew tell told ask asked say said see saw
decide decided explain explained wonder and or but the a an that this
""".split()
QUANTIFIED_FORMAT = r"\bin (?:an? |one |two |three |four |five |\d+ )?(?:short |brief |few )?(?:bullets?|points?|lines?|sentences?|words?)\b"
REFINEMENT = r"\b(actually|also|wait|but |instead|what if|in addition|one more thing|it was|they were|turns out|forgot to (?:say|mention)|make it)\b"
CLAUSE_BOUNDARY = r",\s+and\s+|,\s+|\s+and\s+also\s+|\s+and\s+|\s+plus\s+|;\s*"
LEAD_FILLER = (
    r"^(?:i\s+(?:need|want|would\s+like|am\s+looking\s+for)|can\s+you\s+(?:tell\s+me|find|give\s+me)|"
    r"please\s+(?:tell\s+me|find)|tell\s+me|what\s+(?:is|are)|i'?m\s+looking\s+for)\s+(?:about\s+)?(?:to\s+)?"
)
ARTICLE_LEAD = r"^(?:the|a|an|my|our)\s+"
DISCOURSE = (
    r"^(?:(?:actually|also|wait|oh|so|okay|ok|well|one\s+more\s+thing|it\s+turns\s+out(?:\s+that)?|"
    r"i\s+forgot\s+to\s+(?:say|mention)(?:\s+that)?)[\s,.:;—–-]*)+"
)
QUESTION_START = (
    r"^(?:what|who|whom|whose|which|when|where|why|how|is|are|was|were|do|does|did|can|could|"
    r"should|would|will|has|have|had)\b"
)
NEEDS_CONTEXT = (
    r"^(?:(?:it|its|he|his|she|her|they|their|them|this|these|those|such)\b"
    r"|(?:as of|on|in|at|by|since|after|before|until) (?:that|this|those|these|the same)\b"
    r"|(?:that|the same) (?:day|year|time|month|period)\b|the (?:former|latter)\b)"
)
CONTINUES = r"^(?:it|its|he|his|she|her|they|their|them|this|these|those)\b"
DEFINITIONAL = r"\b(?:what\s+does\s+([A-Za-z]{2,6})\s+stand\s+for|what\s+is\s+(?:an?\s+)?([A-Za-z]{2,6})\b|define\s+([A-Za-z]{2,6})\b)"
NUMBER = r"\b\d+(?:\.\d+)?\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~–—‘’“”"
STABILITY_FEATURES = "strong_anchor topic_anchor bigram_anchor weak_anchor ends_mid_thought no_new_content n_content n_words wh_opener ends_question".split()
STABILITY_WEIGHTS = (0.673179, 0.779582, 0.858823, 1.332737, -0.353244, 0.905012, 1.065148, 1.440227, 0.542955, 5.148515)
STABILITY_BIAS = -4.417542
ERROR_CLASSES = {
    "first_stage": "A", "rerank_depth": "A", "query_formulation": "A", "context_selection": "B", "chunking": "B", "wrong_document": "B2",
    "sentence_selection": "C", "answer_not_in_text": "D", "merge_lost": "D", "decomposition": "E", "cross_intent_contamination": "F",
    "refusal_gate": "H1", "refusal": "H2", "relevance_gate": "H3",
}
TURN_MARKS = "utterance_end final_decision retrieval_wait synthesis answer_telemetry output".split()
FEATURES = "top sentence reader_margin overlap_ce overlap_section margin nli_contra_rd nli_entail_rd agree".split()
FEATURE_DEFAULTS = {"sentence": -10.0, "reader_margin": -10.0, "nli_contra_rd": 0.5, "nli_entail_rd": 0.5}
RECORD_FIELDS = "retrieval_events sub_queries answer citations uncertainty".split()
CLAIM_STOPWORDS = """
a an and are as at be been but by can could does do for from had has have how i
if in into is it its may might must no not of on or our over per shall should
so such than that the their then there these they this those to under up was
were what when where which while who will with would you your
""".split()
CLAIM_WORD = r"[a-z0-9][a-z0-9'-]*"
DEGRADED_ANSWER = "I'm not able to complete this right now."
DEGRADED_DOUBT = "internal error or timeout prevented a grounded answer"
# End of fixed values.
