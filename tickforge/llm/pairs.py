"""Broken question-answer pairs: noisy labelling functions combined by an expectation-maximization label model.

Each defect has several labelling functions. One votes + (defect), - (sound) or 0 (abstains). They look at different
things: wording, structure and punctuation, overlap with the question, figures, script and function words, how words end
sentences in the whole corpus, and the flag that came with the answer. Functions that look at the same thing depend on
each other, so they form a block (``BLOCKS``): the evidence of a block's votes is divided by its design effect,
1 + (votes - 1) * correlation, the correlation within the classes being estimated with the rest; only blocks count as
independent of each other. For each defect the model is fitted by EM to the counts of all vote patterns, of which there
are at most 3 to the number of functions, whatever the number of pairs.

Cutoffs are validated: a defect of each kind is planted in every pair that the fitted model holds for sound, and a
defect's cutoff is the one nearest to a half of those that separate planted from sound pairs best. The pairs are planted
in groups, by a hash, on the executors; the driver sees counts of vote patterns. A pair has the labels whose posteriors
reach their cutoffs; ``one_defect`` takes the first of them by ``PRECEDENCE``.

Defined cases: a null or blank answer is empty; a null question can't be copied and has no language, other defects
still hold; the refused flag is one vote among others, and a table without it has that function abstain; repeated rows
and ids get equal labels; answers are used whole, whatever their length; an answer in a language that no function knows
is seen by its script or by the absence of the question's function words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.workspace import written

PRECEDENCE = ("empty", "refusal", "copied", "language", "truncated")
#: Sound pairs that lend each other answers when defects are planted, about; and how many lenders of each language, and
#: refusals, a group has on average at least. Where these are scarce they are lent to several groups, so that a group is
#: without them with a chance below exp(-LENDERS).
PLANTED_TOGETHER, LENDERS = 1000, 40
EM_ROUNDS = 60
#: A word that stands this often in the corpus tells by its share at sentence ends whether an answer may end with it.
KNOWN_WORD, RARE_END, USUAL_END = 20, 0.02, 0.2

# -- features ---------------------------------------------------------------------------------------------------

_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_MARKER = re.compile(r"\[\s*S\d+\s*(?:[-–,]\s*S?\d+\s*)*\]")
_WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
_FILLERS = frozenset("n/a na none null nil nan tbd todo unknown empty answer antwort respuesta réponse reponse undefined blank keine ninguna aucune".split())

# Function words that tell the languages apart.
_FUNCTION_WORDS = {
    "en": "the of and to in for on with that by from is are was were has have its it not but only they at this be an as which what does did how why summarise about do or than more could will can no year against before after".split(),
    "de": "der die das und für von mit im in den dem des ein eine einer zu auf ist sind wurden wurde wird werden nicht sich bei laut bis ende als auch wie was welche nennt sagt über hält weniger dass haben könnten sollen rund aus vor nach seit anhand lässt dazu kann".split(),
    "es": "el la los las de del y en para por con que se es son fue fueron una un no al lo según espera podrían qué cómo riesgos dice sobre afectaron torno menos su sus ha han desde entre esta este más".split(),
    "fr": "le la les de des du et en pour par avec que qui se est sont une un ne pas au aux sur selon ont été quel quels dit sujet effet eu moins plus ce cette dans d'ici s'attend pourraient être leur ses".split(),
    "it": "il la lo gli le di del della dello dei delle e in per con che si è sono una un non al alla nel nella secondo stati entro fine dell'anno dall'anno questo questa rispetto alle agli potrebbero essere ha hanno i da più dopo".split(),
    "pt": "o a os as de do da dos das e em para por com que se é são uma um não ao à no na nos nas segundo foram até fim podem ficar abaixo este esta esse essa mais sua seus pelo pela subiram".split(),
    "nl": "de het een en van in voor met dat op te is zijn niet aan bij volgens worden wordt werd kunnen dit deze einde jaar naar uit ook maar om over heeft hebben verwacht".split(),
}
_FUNCTION_SETS = {lang: frozenset(ws) for lang, ws in _FUNCTION_WORDS.items()}
_DIGITS = re.compile(r"\d+")
_WORD_LANGUAGES: dict[str, list[str]] = {}
for _lang, _ws in _FUNCTION_WORDS.items():
    for _w in _ws:
        _WORD_LANGUAGES.setdefault(_w, []).append(_lang)
_WORD_LANGUAGES |= {w.replace("'", "’"): langs for w, langs in _WORD_LANGUAGES.items()}

#: Wordings by which an answer declines, in the languages of the questions.
_DECLINES = re.compile(
    r"""(?:can(?:no|')t|cannot|could\ not|unable\ to|won't|not\ able\ to)\ (?:be\ )?(?:answer|help|respond|reply|say|determine|establish|tell|comment|provide|address|confirm|assist)
    |(?:do|does|did)\ ?n[o']t\ (?:contain|have|hold|provide|include|offer|give)\ (?:the\ |any\ |enough\ |sufficient\ |that\ )*(?:information|detail|context|data|answer)
    |(?:not|isn't|insufficient|too\ little|no)\ (?:enough\ )?(?:information|context|detail)s?\b
    |information\ (?:needed|required)\ |that\ information\ isn't|information\ is\ not\ available|isn't\ available|not\ available\ in
    |no\ answer\ can\ be|not\ possible\ to\ (?:say|answer|tell|determine)|impossible\ to\ (?:say|answer|tell)
    |decline\ to\ (?:answer|respond|comment)|lack\ the\ (?:context|information)|too\ thin\ for|not\ something\ i\ can|falls\ outside\ what
    |would\ have\ to\ guess|never\ comes?\ up|silent\ (?:on|about)|(?:is|are)\ not\ (?:covered|mentioned|addressed)\ (?:by|in)
    |nothing\ (?:in|on|about|of\ the\ kind)|none\ of\ the\ (?:sources|passages|excerpts|pages|documents)|no\ (?:passage|source|excerpt|page|figure,?)\b.*\b(?:mentions?|address(?:es)?|covers?|appears?|discuss(?:es)?)
    |(?:passages|excerpts|pages|sources|documents)\ (?:supplied\ )?(?:do\ not|don't)\ (?:mention|address|cover|say|contain)
    |nicht\ (?:beantwort|zu\ beantwort)|nichts\ sagen|nicht\ genug\ (?:angaben|informationen)|erwähnen\ .*\bnicht\b|keine\ (?:angaben|informationen|auskunft)|lässt\ sich\ .*\bnicht\b\ ?(?:beantworten|sagen)|um\ diese\ frage\ zu\ beantworten
    |no\ permiten?\ (?:contestar|responder)|no\ puedo\ (?:responder|contestar|ayudar)|no\ (?:contienen?|hay|tengo)\ (?:la\ )?(?:información|informacion|datos)|no\ mencionan?|no\ es\ posible\ (?:responder|contestar|decir)
    |ne\ permett(?:ent|ait)\ pas|ne\ peux\ pas\ (?:répondre|vous\ aider)|ne\ (?:contiennent|contient)\ pas|ne\ mentionn(?:ent|e)\ pas|pas\ possible\ de\ (?:répondre|dire)|pas\ assez\ d['’]informations?""",
    re.IGNORECASE | re.VERBOSE,
)
_SORRY = re.compile(r"\b(?:sorry|apologi[sz]e|regrettably|unfortunately|to be candid|as an assistant|leider|bedaure|lo siento|lamentablemente|désolée?|malheureusement)\b", re.IGNORECASE)
#: What may stand beside a refusal without answering.
_AROUND = re.compile(r"please (?:rephrase|supply|provide|ask|try)|rephrase|widen the search|try asking|what is missing|^missing\b|fuller excerpt|leave it there|full report|another company|bitte|por favor|veuillez", re.IGNORECASE)
#: A gap that is noted before the answer goes on.
_BUT = re.compile(r"but they do say|but (?:it|they|the \w+) do(?:es)? (?:say|state|mention|note)|the following", re.IGNORECASE)

_FIRMS = re.compile(r"\b(Inc|Corp|Co|Ltd|Mio|Mrd|Tsd|No|Nr|vs|bzw|approx)\.(?=\s)")
_ENDS = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|\n+")
_CLOSED = re.compile(r"[.!?][\"”’»)\]]*$")
_DANGLING = frozenset(
    "the a an of and or to in for on with by from at as that than but its is are was has have der die das und oder zu für von mit im in den dem ein eine auf als el la los las de del y o en para por con que se un una le les des du et ou au aux dans pour par avec sur qui d'ici it which when rising".split()
)


def clean(text: str | None) -> str:
    return unicodedata.normalize("NFKC", (text or "").translate(_INVISIBLE)).strip()


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def body_of(answer: str) -> str:
    """The answer without citation markers."""
    return " ".join(_MARKER.sub(" ", answer).split())


def sentences_of(answer: str) -> list[str]:
    flat = _FIRMS.sub(lambda m: m.group(1) + "․", _MARKER.sub(" ", answer))
    return [s.strip().replace("․", ".") for s in _ENDS.split(flat) if s and _WORD.search(s)]


def language_scores(words: list[str]) -> Counter:
    """Weight of each language's function words: a word of k languages gives 1/k to each."""
    out: dict[str, float] = {}
    for langs in filter(None, map(_WORD_LANGUAGES.get, words)):
        for x in langs:
            out[x] = out.get(x, 0) + 1 / len(langs)
    return Counter(out)


def _guess(words: list[str], margin: float) -> str | None:
    return _likely(language_scores(words), margin)


def _likely(scores: Counter, margin: float) -> str | None:
    top = scores.most_common(2)
    if not top or top[0][1] < 1.0:
        return None
    return top[0][0] if len(top) == 1 or top[0][1] >= margin * top[1][1] else None


def declines(sentence: str) -> bool:
    if _BUT.search(sentence) and not re.search(r"guess|leave it", sentence):
        return False
    return bool(_DECLINES.search(sentence)) or bool(_SORRY.search(sentence))


# -- labelling functions ----------------------------------------------------------------------------------------


class Pair:
    """A pair with the features that several functions use."""

    def __init__(self, question: str | None, answer: str | None, flag: bool | None = None):
        self.flag = flag
        self.question, self.answer = clean(question), clean(answer)

    @cached_property
    def body(self) -> str:
        return body_of(self.answer)

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.body)

    @cached_property
    def asked(self) -> list[str]:
        return words_of(self.question)

    @cached_property
    def asked_in(self) -> str | None:
        """The question's language."""
        return _guess(self.asked, 1.0)

    @cached_property
    def scores(self) -> Counter:
        return language_scores(self.words)

    @cached_property
    def sentences(self) -> list[str]:
        return sentences_of(self.answer)

    @cached_property
    def declined(self) -> list[bool]:
        return [declines(s) for s in self.sentences]

    @cached_property
    def declining(self) -> list[str]:
        return [s for s, no in zip(self.sentences, self.declined) if no]

    @cached_property
    def substance(self) -> list[str]:
        return [s for s, no in zip(self.sentences, self.declined) if not no and not _AROUND.search(s) and not _BUT.search(s)]

    @cached_property
    def unseen(self) -> int:
        distinct = set(self.words) - set(self.asked)
        return len([w for w in distinct if w not in ("question", "frage", "pregunta", "q", "answer")])

    @cached_property
    def is_filler(self) -> bool:
        return all(w in _FILLERS for w in self.words) or self.body.lower().strip(" .:-_*\"'[](){}") in _FILLERS

    @cached_property
    def is_list(self) -> bool:
        return bool(re.search(r"(?:^|\n)\s*[-*•] ", self.answer))


def _empty_no_word(p: Pair) -> int:
    return 1 if not p.words else (-1 if p.is_filler else 0)


def _empty_fillers(p: Pair) -> int:
    return int(p.is_filler)


def _empty_short(p: Pair) -> int:
    return int(sum(map(len, p.words)) < 2) if not p.words else (0 if len(p.words) > 2 else -1)


def _refusal_wording(p: Pair) -> int:
    return int(bool(p.declining) and not p.substance)


def _refusal_substance(p: Pair) -> int:
    if not p.sentences:
        return -1
    return 0 if p.substance else 1


def _refusal_first(p: Pair) -> int:
    if not p.sentences:
        return -1
    return int(p.declined[0] and len(p.substance) <= 0)


def _copied_containment(p: Pair) -> int:
    """All words stem from the question."""
    if len(p.words) < 2 or not p.asked:
        return -1
    return int(p.unseen <= max(0, len(set(p.words)) // 8) and len(p.words) <= 2 * len(p.asked) + 2)


def _copied_order(p: Pair) -> int:
    """The words follow each other as in the question."""
    if len(p.words) < 3 or len(p.asked) < 3:
        return -1
    have = set(zip(p.asked, p.asked[1:]))
    got = list(zip(p.words, p.words[1:]))
    return int(sum(g in have for g in got) >= 0.6 * len(got) and p.unseen <= 2)


def _copied_adds(p: Pair) -> int:
    """Nothing is added that could answer."""
    if not p.asked or not p.words:
        return -1
    return 0 if p.unseen >= 3 else (1 if len(p.words) >= 3 and p.unseen == 0 and any(w in p.asked for w in p.words) else -1)


def _language_function_words(p: Pair) -> int:
    a, q = _likely(p.scores, 1.3), p.asked_in
    return -1 if a is None or q is None else int(a != q)


def _language_first_sentence(p: Pair) -> int:
    quoted = re.sub(r"[“\"«„][^”\"»“]*[”\"»“]", " ", p.body)
    a, q = _likely(p.scores if quoted == p.body else language_scores(words_of(quoted)), 1.6), p.asked_in
    return -1 if a is None or q is None else int(a != q)


def _language_overlap(p: Pair) -> int:
    """The question's own language hardly occurs in the answer."""
    q = p.asked_in
    if q is None or len(p.words) < 5:
        return -1
    s = p.scores
    best = max(s.values(), default=0.0)
    return -1 if best < 1.5 else int(s[q] < 0.6 * best)


def _language_absent(p: Pair) -> int:
    """The function words of the question's language are missing from a long answer."""
    q = p.asked_in
    if q is None or len(p.words) < 8:
        return -1
    share = sum(w.replace("’", "'") in _FUNCTION_SETS[q] for w in p.words) / len(p.words)
    return 1 if share < 0.04 else 0 if share > 0.15 else -1


def _language_script(p: Pair) -> int:
    """Most letters are of another script than the question's."""
    a, q = _latin(p.body), _latin(p.question)
    return -1 if a is None or q is None else int(abs(a - q) > 0.5)


def _latin(text: str) -> float | None:
    """Share of Latin letters, None without enough letters."""
    if text.isascii():
        return 1.0 if sum(map(str.isalpha, text)) >= 4 else None
    letters = [c for c in text if c.isalpha()]
    return sum(c < "\u0250" for c in letters) / len(letters) if len(letters) >= 4 else None


def _copied_letters(p: Pair) -> int:
    """Letter triples are those of the question, about as many."""
    if len(p.body) < 8 or len(p.question) < 8:
        return -1
    if len(p.body) > 3 * len(p.question):
        return 0
    a, q = (set(map("".join, zip(t, t[1:], t[2:]))) for t in (" ".join(p.words), " ".join(p.asked)))
    inside = len(a & q) / max(1, len(a))
    shared = len(a & q) / max(1, len(q))  # most of the question, or all of it with a few words before or after
    return 1 if (inside >= 0.85 and shared >= 0.5) or (inside >= 0.72 and shared >= 0.95) else 0 if inside < 0.6 else -1


def _refusal_flag(p: Pair) -> int:
    return -1 if p.flag is None else int(p.flag)


def _refusal_figures(p: Pair) -> int:
    """A figure that the question doesn't have is an answer of some kind; its absence says little."""
    if not p.words:
        return -1
    return int(not set(_DIGITS.findall(p.body)) - set(_DIGITS.findall(p.question)))


def _empty_letters(p: Pair) -> int:
    """Hardly any letters or figures among the characters."""
    if not p.answer:
        return 1
    share = sum(map(str.isalnum, p.body)) / len(p.answer)
    return 1 if share < 0.2 else 0 if share > 0.6 else -1


def _tail(p: Pair) -> str:
    """The answer up to its last complete citation markers."""
    t = p.answer
    while True:
        cut = re.sub(r"\s*\[\s*S\d+\s*(?:[-–,]\s*S?\d+\s*)*\]\s*$", "", t)
        if cut == t:
            return t.rstrip()
        t = cut


def _brief(p: Pair) -> bool:
    """A figure alone, which needs no full stop."""
    return len(p.words) <= 4 and "," not in p.body and any(c.isdigit() for c in p.body) and p.words[-1] not in _DANGLING


def _truncated_open_end(p: Pair) -> int:
    t = _tail(p)
    if not p.words:
        return -1
    if re.search(r"[….]{2,}$|…$|[,;:(\[—–\-]$|\[S\d*$", t):
        return 1
    if _CLOSED.search(t):
        return 0
    if p.is_list:
        return -1
    return 0 if _brief(p) else 1


def _truncated_marker(p: Pair) -> int:
    """A citation marker or a bracket is left open at the end."""
    if re.search(r"\[\s*S?\d*\s*$|\(\s*$", p.answer):
        return 1
    t = _tail(p)
    return 0 if _CLOSED.search(t) and not t.endswith("..") else -1


def _truncated_last_word(p: Pair) -> int:
    """The last word can't end a sentence, or the last list item is no item."""
    if not p.words:
        return -1
    t = _tail(p)
    if p.is_list:
        item = re.split(r"\n\s*[-*•] ?", t)[-1].strip()
        if not item or item.split()[-1].lower() in _DANGLING or len(item.split()) < 3:
            return 1
        return 0 if not t.endswith((",", "-", "—")) else 1
    if re.search(r"\b(?:Inc|Corp|Mio|Tsd|Ltd|Co)\.$", t) and not p.question.rstrip(" ?.!").endswith(re.sub(r"\W+$", "", t[-12:]).split()[-1]):
        return 1
    if _CLOSED.search(t) and not t.endswith("..."):
        return 0
    return int(t.split()[-1].lower().strip("“\"") in _DANGLING) or -1


def _truncated_quote(p: Pair) -> int:
    """A quotation is left open, or all are closed."""
    opened, closed = (sum(p.answer.count(c) for c in cs) for cs in ("“„«", "”»"))
    if not opened:
        return -1
    return int(opened > closed and max(map(p.answer.rfind, "“„«")) > max(map(p.answer.rfind, "”»")))


def _language_absent(p: Pair) -> int:
    """The function words of the question's language are missing from a long answer."""
    q = p.asked_in
    if q is None or len(p.words) < 8:
        return -1
    share = sum(w.replace("’", "'") in _FUNCTION_SETS[q] for w in p.words) / len(p.words)
    return 1 if share < 0.04 else 0 if share > 0.15 else -1


def _language_script(p: Pair) -> int:
    """Most letters are of another script than the question's."""
    a, q = _latin(p.body), _latin(p.question)
    return -1 if a is None or q is None else int(abs(a - q) > 0.5)


def _latin(text: str) -> float | None:
    """Share of Latin letters, None without enough letters."""
    if text.isascii():
        return 1.0 if sum(map(str.isalpha, text)) >= 4 else None
    letters = [c for c in text if c.isalpha()]
    return sum(c < "\u0250" for c in letters) / len(letters) if len(letters) >= 4 else None


def _copied_letters(p: Pair) -> int:
    """Letter triples are those of the question, about as many."""
    if len(p.body) < 8 or len(p.question) < 8:
        return -1
    if len(p.body) > 3 * len(p.question):
        return 0
    a, q = (set(map("".join, zip(t, t[1:], t[2:]))) for t in (" ".join(p.words), " ".join(p.asked)))
    inside = len(a & q) / max(1, len(a))
    shared = len(a & q) / max(1, len(q))  # most of the question, or all of it with a few words before or after
    return 1 if (inside >= 0.85 and shared >= 0.5) or (inside >= 0.72 and shared >= 0.95) else 0 if inside < 0.6 else -1


def _refusal_flag(p: Pair) -> int:
    return -1 if p.flag is None else int(p.flag)


def _refusal_figures(p: Pair) -> int:
    """A figure that the question doesn't have is an answer of some kind; its absence says little."""
    if not p.words:
        return -1
    return int(not set(_DIGITS.findall(p.body)) - set(_DIGITS.findall(p.question)))


def _empty_letters(p: Pair) -> int:
    """Hardly any letters or figures among the characters."""
    if not p.answer:
        return 1
    share = sum(map(str.isalnum, p.body)) / len(p.answer)
    return 1 if share < 0.2 else 0 if share > 0.6 else -1


def _tail(p: Pair) -> str:
    """The answer up to its last complete citation markers."""
    t = p.answer
    while True:
        cut = re.sub(r"\s*\[\s*S\d+\s*(?:[-–,]\s*S?\d+\s*)*\]\s*$", "", t)
        if cut == t:
            return t.rstrip()
        t = cut


def _brief(p: Pair) -> bool:
    """A figure alone, which needs no full stop."""
    return len(p.words) <= 4 and "," not in p.body and any(c.isdigit() for c in p.body) and p.words[-1] not in _DANGLING


def _truncated_open_end(p: Pair) -> int:
    t = _tail(p)
    if not p.words:
        return -1
    if re.search(r"[….]{2,}$|…$|[,;:(\[—–\-]$|\[S\d*$", t):
        return 1
    if _CLOSED.search(t):
        return 0
    if p.is_list:
        return -1
    return 0 if _brief(p) else 1


def _truncated_marker(p: Pair) -> int:
    """A citation marker or a bracket is left open at the end."""
    if re.search(r"\[\s*S?\d*\s*$|\(\s*$", p.answer):
        return 1
    t = _tail(p)
    return 0 if _CLOSED.search(t) and not t.endswith("..") else -1


def _truncated_last_word(p: Pair) -> int:
    """The last word can't end a sentence, or the last list item is no item."""
    if not p.words:
        return -1
    t = _tail(p)
    if p.is_list:
        item = re.split(r"\n\s*[-*•] ?", t)[-1].strip()
        if not item or item.split()[-1].lower() in _DANGLING or len(item.split()) < 3:
            return 1
        return 0 if not t.endswith((",", "-", "—")) else 1
    if re.search(r"\b(?:Inc|Corp|Mio|Tsd|Ltd|Co)\.$", t) and not p.question.rstrip(" ?.!").endswith(re.sub(r"\W+$", "", t[-12:]).split()[-1]):
        return 1
    if _CLOSED.search(t) and not t.endswith("..."):
        return 0
    return int(t.split()[-1].lower().strip("“\"") in _DANGLING) or -1


def _truncated_quote(p: Pair) -> int:
    """A quotation is left open."""
    return 1 if p.answer.count("“") + p.answer.count("„") > p.answer.count("”") + p.answer.count("«") and p.answer.rfind("“") > p.answer.rfind("”") else -1


FUNCTIONS: dict[str, tuple[Callable[[Pair], int], ...]] = {
    "empty": (_empty_no_word, _empty_fillers, _empty_short, _empty_letters),
    "refusal": (_refusal_wording, _refusal_substance, _refusal_first, _refusal_flag, _refusal_figures),
    "copied": (_copied_containment, _copied_order, _copied_adds, _copied_letters),
    "language": (_language_function_words, _language_first_sentence, _language_overlap, _language_absent, _language_script),
    "truncated": (_truncated_open_end, _truncated_marker, _truncated_last_word, _truncated_quote),
}
#: Sizes of the blocks of functions that depend on each other, in order. The last of truncated is the corpus's vote.
BLOCKS = {"empty": (3, 1), "refusal": (3, 1, 1), "copied": (3, 1), "language": (3, 1, 1), "truncated": (3, 1, 1)}


def _votes(p: Pair, d: str) -> str:
    return "".join({1: "+", 0: "-"}.get(f(p), "0") for f in FUNCTIONS[d])


def _last_word(p: Pair) -> str | None:
    return p.words[-1] if p.words and not p.is_list and not _CLOSED.search(_tail(p)) else None


def votes_of(question: str | None, answer: str | None, flag: bool | None = None) -> dict[str, str]:
    """Defect -> its functions' votes as a string of +, - and 0 (0: abstains), ``last_word``: the word with which an answer
    ends that isn't closed (an item of a list needs no end), and ``asked_in``: the question's language."""
    p = Pair(question, answer, flag)
    return {d: _votes(p, d) for d in FUNCTIONS} | {"last_word": _last_word(p), "asked_in": p.asked_in}


def _end_vote():
    """What the corpus says about a last word: it stands in it ``total`` times, ``final`` times at a sentence's end."""
    share = F.col("final") / F.col("total")
    return F.when(F.coalesce("total", F.lit(0)) < KNOWN_WORD, "0").when(share < RARE_END, "+").when(share > USUAL_END, "-").otherwise("0")


# -- label model ------------------------------------------------------------------------------------------------


class LabelModel:
    """Two classes, sound and defective; per function and class its share of votes for the defect among its votes (that it
    abstains says nothing), and per block the correlation of its functions within the classes.

    Pseudo-counts say what a function is: right more often than not, and that a weak one (any outside the first block) is
    Pseudo-votes, a fiftieth of the pairs and ``WEIGHT`` more, say what a function is: right more often than not, and a
    weak one (any outside the first block) right only somewhat more often. Nothing else holds the classes in place: the
    defect's share is free."""

    STRONG, WEAK, WEIGHT, PER_PAIR = (0.03, 0.85), (0.35, 0.55), 8.0, 0.02

    def __init__(self, blocks: tuple[int, ...]):
        self.block = np.repeat(np.arange(len(blocks)), blocks)
        self.base = np.array([[(self.STRONG if b == 0 else self.WEAK)[k] for b in self.block] for k in (0, 1)])
        self.rate, self.rho, self.prior = self.base.copy(), np.zeros(len(blocks)), 0.05

    def _log_odds(self, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        ratio = yes * np.log(self.rate[1] / self.rate[0]) + no * np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        out = np.full(len(yes), np.log(self.prior / (1 - self.prior)))
        for b, rho in enumerate(self.rho):
            of = self.block == b
            votes = (yes | no)[:, of].sum(1)
            out += ratio[:, of].sum(1) / (1 + np.maximum(votes - 1, 0) * rho)
        return out

    def _correlation(self, yes: np.ndarray, no: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Per block the mean correlation of two functions' votes within a class, over the pairs that both vote on."""
        rho = np.zeros(len(self.rho))
        for b in range(len(rho)):
            top = below = 0.0
            members = np.flatnonzero(self.block == b)
            for i, f in enumerate(members):
                for g in members[i + 1 :]:
                    both = (yes | no)[:, f] & (yes | no)[:, g]
                    for k, w in enumerate(weights):
                        w = w * both
                        if w.sum() > 0:
                            x, y = yes[:, f] - self.rate[k][f], yes[:, g] - self.rate[k][g]
                            top += (w * x * y).sum()
                            below += np.sqrt((w * x * x).sum() * (w * y * y).sum())
            rho[b] = np.clip(top / below, 0.0, 1.0) if below > 0 else 0.0
        return rho

    def fit(self, patterns: dict[str, int], rounds: int = EM_ROUNDS) -> LabelModel:
        keys = sorted(patterns)
        if not keys:
            return self
        n = np.array([patterns[k] for k in keys], float)
        yes, no = (np.array([[v == sign for v in k] for k in keys]) for sign in "+-")
        pseudo = self.WEIGHT + self.PER_PAIR * n.sum()
        for _ in range(rounds):
            post = 1 / (1 + np.exp(-self._log_odds(yes, no)))
            self.prior = float(((n * post).sum() + 0.05) / (n.sum() + 1.0))
            weights = [n * (1 - post), n * post]
            for k, w in enumerate(weights):
                self.rate[k] = ((w[:, None] * yes).sum(0) + pseudo * self.base[k]) / ((w[:, None] * (yes | no)).sum(0) + pseudo)
            self.rate = np.clip(self.rate, 1e-4, 1 - 1e-4)
            self.rho = self._correlation(yes, no, weights)
        return self

    def posterior(self, key: str) -> float:
        odds = self._log_odds(*(np.array([[v == sign for v in key]]) for sign in "+-"))[0]
        return float(1 / (1 + np.exp(-odds)))


def fit_label_model(patterns: dict[str, int], blocks: tuple[int, ...] | None = None) -> dict[str, float]:
    """Posterior of the defect for each vote pattern; all functions in one block unless told otherwise."""
    if not patterns:
        return {}
    model = LabelModel(blocks or (len(next(iter(patterns))),)).fit(patterns)
    return {k: model.posterior(k) for k in patterns}


def best_cutoff(sound: list[float], planted: list[float], n_sound: list[int] | None = None, n_planted: list[int] | None = None) -> float:
    """Of the cutoffs with the best F1 on sound and planted pairs the one nearest to a half. Each posterior counts as often
    as ``n_sound`` and ``n_planted`` say, once without them."""
    levels = np.unique(np.clip([0.0, 1.0, *sound, *planted], 1e-6, 1 - 1e-6))
    between = (levels[1:] + levels[:-1]) / 2
    if not planted or not len(between):
        return 0.5

    def reaching(posteriors: list[float], n: list[int] | None) -> np.ndarray:
        order = np.argsort(posteriors)
        below = np.concatenate([[0], np.cumsum((np.ones(len(posteriors), int) if n is None else np.array(n, int))[order])])
        return below[-1] - below[np.searchsorted(np.array(posteriors, float)[order], between)]

    found, wrong, n = reaching(planted, n_planted), reaching(sound, n_sound), len(planted) if n_planted is None else sum(n_planted)
    f1 = 2 * found / (found + wrong + n)
    best = np.flatnonzero(f1 == f1.max())
    nearest = [min(max(0.5, levels[k] + 1e-9), levels[k + 1]) for k in best]
    return float(min(nearest, key=lambda x: abs(x - 0.5)))


def _plant(sound: list[tuple[str, str]], refusals: list[str], lenders: list[tuple[str, str]] | None = None) -> dict[str, list[tuple[str, str]]]:
    """Defects of each kind made from sound pairs, without the labelling functions; ``lenders`` are sound pairs that only
    lend their answers. A question without words can't be copied and has no other language."""
    out: dict[str, list[tuple[str, str]]] = {d: [] for d in PRECEDENCE}
    by_language: dict[str, list[str]] = {}
    asked = [words_of(clean(q)) for q, _ in sound]
    languages = [_guess(ws, 1.0) for ws in asked]
    lent = [_guess(words_of(clean(q)), 1.0) for q, _ in lenders or ()]
    for lang, (_, a) in zip([*languages, *lent], [*sound, *(lenders or ())]):
        by_language.setdefault(lang or "", []).append(a)
    for k, ((q, a), ws, lang) in enumerate(zip(sound, asked, languages)):
        out["empty"].append((q, ("", " ", "...", "[S1]", "-", "n/a", "[S2][S3]", "\n\n")[k % 8]))
        if ws:
            out["copied"].append((q, (q, q.lower(), q.upper(), q.rstrip("?. "), f"{q} {q}", q.replace(" ", "  "))[k % 6]))
        words = (a or "").split()
        spots = len(words) - 4 if len(words) >= 6 else 0
        for at in (3 + (k * 7919 + j) % spots for j in range(spots)):  # the first from there on that is inside a sentence
            if not re.search(r"[.!?:\]]$", words[at - 1]) and not re.search(r"[.!?]", words[at]):
                cut = " ".join(words[:at]) + (" " + words[at][: len(words[at]) // 2] if k % 2 and len(words[at]) > 3 else "")
                out["truncated"].append((q, cut))
                break
        others = sorted(x for x in by_language if x and x != lang)
        if lang and others:
            pool = by_language[others[k % len(others)]]
            out["language"].append((q, pool[k // len(others) % len(pool)]))
        if refusals:
            out["refusal"].append((q, refusals[k % len(refusals)]))
    return out


def _word_ends(pairs: DataFrame) -> DataFrame:
    """word, total, final: how often words stand in answers, and how often at the end of a sentence."""
    flat = F.regexp_replace("answer", r"\[\s*S\d+[^\]]*\]", " ")
    got = F.regexp_extract_all(F.lower(flat), F.lit(r"([\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*\s*[.!?]?)"), F.lit(1))
    w = pairs.where(F.col("answer").isNotNull()).select(F.explode(got).alias("w"))
    return w.groupBy(F.regexp_replace("w", r"\s*[.!?]?\z", "").alias("word")).agg(F.count("*").alias("total"), F.count_if(F.col("w").rlike(r"[.!?]\z")).alias("final"))


def pair_votes(pairs: DataFrame, ends: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """id, one vote pattern per defect, question, its language and answer for every pair; written, as it is used several
    times. ``ends`` are the corpus's word ends."""
    names = [*FUNCTIONS, "last_word", "asked_in"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [votes_of(q, a, f) for q, a, f in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)])]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], *[pa.array([g[d] for g in got], pa.string()) for d in names]], [id_col, "question", "answer", *names])

    kind = dict(pairs.dtypes)[id_col]
    flag = F.col("refused").cast("boolean") if "refused" in pairs.columns else F.lit(None).cast("boolean")
    src = pairs.select(F.col(f"`{id_col}`"), "question", "answer", flag.alias("flag"))
    votes = src.mapInArrow(run, f"`{id_col}` {kind}, question STRING, answer STRING, " + ", ".join(f"{d} STRING" for d in names))
    votes = votes.join(ends, F.col("last_word") == F.col("word"), "left")
    return written(votes.select(F.col(f"`{id_col}`"), "question", "asked_in", "answer", *[d for d in FUNCTIONS if d != "truncated"], F.concat("truncated", _end_vote()).alias("truncated")), "votes")


def vote_counts(votes: DataFrame) -> dict[str, dict[str, int]]:
    """Defect -> pattern -> number of pairs. At most 3 ** (number of functions) patterns a defect."""
    rows = votes.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("p")) for d in FUNCTIONS])).alias("x")).groupBy("x.d", "x.p").count().collect()
    out: dict[str, dict[str, int]] = {d: {} for d in FUNCTIONS}
    for r in rows:
        out[r["d"]][r["p"]] = r["count"]
    return out


def _chosen(posteriors: dict[str, dict[str, float]], rule) -> dict[str, list[str]]:
    return {d: [p for p, x in ps.items() if rule(d, p, x)] for d, ps in posteriors.items()}


def _planted_together(group: pa.Table) -> pa.Table:
    """Counts of the votes on the defects planted in one group of pairs."""
    rows = sorted(zip(*[group.column(k).to_pylist() for k in ("h", "question", "answer", "role")]), key=lambda r: (r[0], r[1] or "", r[2] or ""))
    sound, lenders = ([(q, a) for _, q, a, role in rows if role == r] for r in ("sound", "lender"))
    seen: Counter = Counter()
    for d, planted in _plant(sound, [a for _, _, a, role in rows if role == "refusal"], lenders).items():
        for q, a in planted:
            p = Pair(q, a)
            seen[d, _votes(p, d), _last_word(p) if d == "truncated" else None] += 1
    return pa.table([pa.array([k[i] for k in seen], pa.string()) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], ["d", "p", "last_word", "n"])


def planted_counts(votes: DataFrame, ends: DataFrame, is_sound, is_refusal) -> dict[str, dict[str, int]]:
    """Defect -> pattern -> number of planted pairs. Every sound pair is planted once with each defect that it can have."""
    pool = F.when(is_sound, F.coalesce("asked_in", F.lit(""))).when(is_refusal & F.col("answer").isNotNull(), "refusal")
    rows = votes.select(F.xxhash64(*[F.col(f"`{c}`") for c in votes.columns]).alias("h"), "question", "answer", pool.alias("pool")).where("pool IS NOT NULL")
    sizes = {r["pool"]: r["count"] for r in rows.groupBy("pool").count().collect()}
    groups = -(-sum(n for k, n in sizes.items() if k != "refusal") // PLANTED_TOGETHER)
    out: dict[str, dict[str, int]] = {d: {} for d in FUNCTIONS}
    if not groups:
        return out
    copies = {k: min(groups, -(-LENDERS * groups // n)) if k else 1 for k, n in sizes.items()}
    of_pool = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(copies.items()) for x in kv]), F.col("pool"))
    rows = rows.withColumn("copies", of_pool).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    group = F.pmod(F.pmod("h", F.lit(groups)) + F.floor(F.col("copy") * F.lit(groups) / F.col("copies")), F.lit(groups))
    role = F.when(F.col("pool") == "refusal", "refusal").when(F.col("copy") == 0, "sound").otherwise("lender")
    seen = rows.select(group.alias("g"), "h", "question", "answer", role.alias("role")).groupBy("g").applyInArrow(_planted_together, "d STRING, p STRING, last_word STRING, n BIGINT")
    seen = seen.groupBy("d", "p", "last_word").agg(F.sum("n").alias("n")).join(ends, F.col("last_word") == F.col("word"), "left")
    whole = F.concat("p", F.when(F.col("d") == "truncated", _end_vote()).otherwise(""))
    for r in seen.groupBy("d", whole.alias("p")).agg(F.sum("n").alias("n")).collect():
        out[r["d"]][r["p"]] = r["n"]
    return out


def validated_cutoffs(votes: DataFrame, ends: DataFrame, models: dict[str, LabelModel], counts: dict[str, dict[str, int]]) -> dict[str, float]:
    """Cutoffs from defects planted in all sound pairs."""
    post = {d: {p: models[d].posterior(p) for p in counts[d]} for d in FUNCTIONS}
    is_sound = F.lit(True)
    for d in FUNCTIONS:
        is_sound = is_sound & F.col(d).isin([p for p, x in post[d].items() if x < 0.5])
    is_refusal = F.col("refusal").isin([p for p, x in post["refusal"].items() if x > 0.99])
    sound, planted = vote_counts(votes.where(is_sound)), planted_counts(votes, ends, is_sound, is_refusal)
    return {d: best_cutoff(*[[models[d].posterior(p) for p in ps[d]] for ps in (sound, planted)], *[list(ps[d].values()) for ps in (sound, planted)]) for d in FUNCTIONS}


def fit(pairs: DataFrame, id_col: str = "answer_id") -> tuple[DataFrame, dict[str, dict[str, float]], dict[str, float], dict[str, dict[str, int]]]:
    """(votes, posteriors by pattern, cutoffs, counts by pattern)."""
    ends = written(_word_ends(pairs), "word_ends")
    votes = pair_votes(pairs, ends, id_col)
    counts = vote_counts(votes)
    models = {d: LabelModel(BLOCKS[d]).fit(counts[d]) for d in FUNCTIONS}
    cutoffs = validated_cutoffs(votes, ends, models, counts)
    return votes, {d: {p: models[d].posterior(p) for p in counts[d]} for d in FUNCTIONS}, cutoffs, counts


def _looked_up(table: dict[str, float], d: str):
    if not table:
        return F.lit(0.0)
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), F.col(d))


def pair_posteriors(pairs: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """id and one posterior per defect for every pair."""
    votes, post, _, _ = fit(pairs, id_col)
    return votes.select(id_col, *[_looked_up(post[d], d).alias(d) for d in FUNCTIONS])


def pair_labels(pairs: DataFrame, id_col: str = "answer_id", cutoffs: dict[str, float] | None = None) -> DataFrame:
    """id and ``defects``: all defects whose posteriors reach their cutoffs (the validated ones unless given), by precedence."""
    votes, post, best, _ = fit(pairs, id_col)
    least = best | (cutoffs or {})
    return votes.select(id_col, F.array_compact(F.array(*[F.when(_looked_up(post[d], d) >= least[d], F.lit(d)) for d in PRECEDENCE])).alias("defects"))


def rules_compared(pairs: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """defect, cutoff, and the number of pairs that have it by the model, by any vote for it, by a majority of votes, and by
    both the model and any vote."""
    _, post, cutoffs, counts = fit(pairs, id_col)
    rows = []
    for d in PRECEDENCE:
        model = {p for p, x in post[d].items() if x >= cutoffs[d]}
        some, most = {p for p in counts[d] if "+" in p}, {p for p in counts[d] if p.count("+") > p.count("-")}
        n = lambda ps: sum(counts[d][p] for p in ps)
        rows.append((d, cutoffs[d], n(model), n(some), n(most), n(model & some)))
    return pairs.sparkSession.createDataFrame(rows, "defect STRING, cutoff DOUBLE, by_model BIGINT, by_any BIGINT, by_majority BIGINT, by_model_and_any BIGINT")


def one_defect(pairs: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """id, defect of each defective pair: the first of its defects."""
    return pair_labels(pairs, id_col).where(F.size("defects") > 0).select(id_col, F.col("defects")[0].alias("defect"))
