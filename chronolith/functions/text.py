"""Words, sentences and word lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"  # what the index counts as a word, in lower case
SENTENCE_END = r"(?<=[.!?])\s+"
#: Common English words that the index leaves out.
STOP = tuple(sorted(set("""
a about above across after afterwards again against all almost alone along already also although always am among
amongst an and another any anyhow anyone anything anyway anywhere are around as at back be became because become
been before beforehand behind being below beside besides between beyond both but by can cannot could do done down
due during each eg either else elsewhere enough etc even ever every everyone everything everywhere except few find
first for former formerly found from full further get give go had has hasnt have he hence her here hereafter hereby
herein hers herself him himself his how however i ie if in inc indeed into is it its itself keep last latter least
less ltd made many may me meanwhile might mine more moreover most mostly much must my myself name namely neither
never nevertheless next no nobody none noone nor not nothing now nowhere of off often on once one only onto or other
others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seems
several she should show side since so some somehow someone something sometime sometimes somewhere still such take
than that the their them themselves then thence there thereafter thereby therefore therein these they this those
though through throughout thus to together too toward towards under until up upon us very via was we well were what
whatever when whence whenever where whereas whereby wherein wherever whether which while who whoever whole whom
whose why will with within without would yet you your yours yourself yourselves
""".split())))  # fmt: skip
#: Words that turn a statement round.
NEGATIONS = tuple(sorted("no not none nor never neither nothing nowhere cannot without barely hardly rarely scarcely seldom contrary fail false incorrect lack unlike wrong".split()))
#: Words of opposite meaning.
OPPOSITES = tuple(sorted(tuple(x.split("/")) for x in (
    "worse/better worsen/improve weaker/stronger suboptimal/optimal smaller/larger slower/faster negative/positive lower/higher less/more "
    "insignificant/significant inferior/superior inefficient/efficient ineffective/effective inaccurate/accurate drawback/benefit "
    "disadvantage/advantage decrease/increase underperform/outperform unsuccessful/successful"
).split()))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Every word of a text, in order, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def content_words(text: Column | str) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOP))


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words."""
    n = F.size(tokens)
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i < n), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.concat(tokens, pairs)


def sentences(text: Column | str) -> Column:
    """Sentences: the text cut behind . ! ? and at line ends."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), SENTENCE_END + r"|\n+"), lambda s: F.trim(s) != "")


def normal_sentence(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[ \t\r\n\f]+", " "))


def negated(text: Column | str) -> Column:
    return F.arrays_overlap(words(text), F.array(*map(F.lit, NEGATIONS)))


def question_kind(question: Column | str) -> Column:
    """Which way of retrieval suits a question: comparison, multi-aspect, factual or exploratory; the first rule wins."""
    q = F.trim(F.lower(col(question)))
    size = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    joined = F.size(F.regexp_extract_all(q, F.lit(r"\b(additionally|also|and|or)\b"), F.lit(0)))
    compared = r"\bversus\b|\bvs\b|\bcompar(e\b|i)|\bbetter\s+than\b|\bdifference\s+between\b|\bpros?\s+and\s+cons?\b|\badvantages?\s+(over|of)\b"
    plain = r"^define\b|^(what|where|who|when)\s+is\b|^wh(o|ere)\s+are\b|^wh(o|en)\s+was\b|^where\s+was\b|^when\s+did\b"
    open_ = (
        r"^why\b|^explain\b|^how\s+(can|could|did|do|does|has|have|should)\b|^wh(at|ich)\b.*\bmost\b|\btrend|\bfuture\b|\bimpact\b|\bimplication|\blimitation"
        r"|\bpromising\b|\bfundamental\b|\bsuperseded\b|\bchanged?\b|\bevolved?\b|\bcontradic|\bconflict"
    )
    return (
        F.when(q.rlike(compared), "comparison").when((joined >= 2) | (F.length(q) > 150), "multi-aspect").when(q.rlike(plain), "factual")
        .when(q.rlike(open_), "exploratory").when(size <= 4, "factual").when(size > 8, "exploratory").otherwise("factual")
    )
