"""Broken prompt and response pairs.

Each reply gets at most one defect, looked for in the order of ``DEFECTS``:

* ``empty``: nothing but blanks, marks, end tokens or a lead-in;
* ``copies_question``: every word of the reply is used up by the words of the question (once, or
  twice for a question said twice), and most of the question is there;
* ``refusal``: it declines or says that it cannot tell (phrases in four languages, in the lower
  case of running text, so that titles do not count);
* ``other_language``: the language posteriors of prompt and reply differ, by a naive Bayes
  classifier over character n-grams; names and titles are taken out before, and a reply that is no
  clause (no finite verb of the language) has no language;
* ``truncated``: no end mark stands there, and the end-of-text likelihood says that the reply stops inside
  something: character n-grams of growing length, each smoothed by the shorter one, tell the odds that
  a text is cut rather than ended where these characters stand last. After a name, which n-grams alone know
  little about, question and reference answer move the odds: a reply that ends with the whole
  reference is complete, one that stops inside a name of it or of the question is not.

The classifiers are fitted on every sentence of documents and replies and every reference answer, sentences being those
of 20 to 400 characters that end with a stop; closing phrases ("as stated in the passage") are counted over all replies.
The n-grams of the languages, which the letters in use bound, go to the executors by broadcast. Those of ends have
no bound: replies whose end has to be judged are written with its last characters, counting takes
only n-grams that a bitmap of fixed size has for these, and counts meet them by a join.

Defined results: a null response is judged by the parsed answer, two nulls are ``empty``; a null
question has no language and is not copied; a null reference answer is no evidence; a reply in
letters that no language of the models has is in another language than one in Latin letters; repeated rows
are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import widen, written

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
#: Bits of the map of n-grams that are asked for (a full map only lets more counts through), characters that are
#: counted at once, and counts from which a task hands over what it has.
MAP_BITS, SLICE, HELD = 23, 1_000_000, 2_000_000
#: Characters of which words and names are told at once.
BLOCK = 200_000
#: Log odds from which two languages differ.
LANGUAGE_ODDS = 3.0
#: Log odds from which an end is taken for a cut, in running text and after a name; what the reference answer and the
#: question add to the latter.
CUT_ODDS, NAME_ODDS = -1.0, 4.0
OPEN_ODDS = 4.0
WHOLE_REFERENCE, INSIDE_REFERENCE, INSIDE_QUESTION, KNOWN_NAME = -8.0, 8.0, 2.0, -4.0
#: An end without a stop that so large a share of all replies has is a closing phrase.
CLOSING_SHARE = 0.002
#: Share of the question's words that a copy must have.
COPY_SHARE = 0.6
N_GRAM, SUFFIX = 3, 10
#: In a language that no model knows, so many n-grams are equally likely.
OPEN_GRAMS = 8000

#: Sentences in the words of daily life, for languages that the corpus has no labels for.
SAMPLES = {
    "en": "he was born in the town and lived there for a long time. she was the sister of the writer. according to the passage this was the one. the film was released first. they do not come from the same country. the answer is the older of the two. it must have been there, as stated in the text. who is the mother of whom and which of them died earlier.",
    "de": "er wurde in der stadt geboren und lebte dort lange. das war vermutlich der bruder von ihr. die beiden kamen nicht aus demselben land. laut dem text lebte er länger als die anderen. der film erschien zuerst. die antwort auf die frage ist nicht bekannt. wie heißt die mutter und wer von ihnen starb früher.",
    "fr": "il est né dans la ville et y a vécu longtemps. c'est la sœur de l'écrivain. non, ils ne viennent pas du même pays. selon le texte il a vécu plus longtemps que les autres. le film est sorti en premier. la grand-mère s'appelait ainsi. la réponse à la question n'est pas connue.",
    "es": "nació en la ciudad y vivió allí muchos años. la respuesta es la abuela de él. según el texto vivió más que los otros. los dos no son del mismo país. fue la película la que salió antes. era la hermana del escritor. cómo se llama y quién de ellos murió primero. la respuesta a la pregunta no se conoce.",
    "nl": "hij werd geboren in de stad en woonde daar lang. zij was de zus van de schrijver. het antwoord op de vraag is niet bekend. de film kwam eerst uit. ze komen niet uit hetzelfde land. volgens de tekst leefde hij langer dan de anderen. zijn grootmoeder heette zo en dat weet ik niet. van het boek zijn er veel.",
    "it": "è nato nella città e ha vissuto lì per molto tempo. la nonna di lui si chiamava così. il film è uscito per primo. non vengono dallo stesso paese. secondo il testo visse più a lungo degli altri. la risposta alla domanda non è nota. era la sorella dello scrittore. gli anni della guerra sono stati difficili.",
    "pt": "ele nasceu na cidade e viveu lá muito tempo. a avó dele chamava-se assim. o filme saiu primeiro. eles não são do mesmo país. segundo o texto viveu mais do que os outros. a resposta não é conhecida. era a irmã do escritor. foi uma coisa muito boa para todos nós.",
    "sv": "hon föddes i staden och bodde där länge. han var bror till författaren. filmen kom ut först. de kommer inte från samma land. enligt texten levde han längre än de andra. svaret på frågan är inte känt. hennes mormor hette så och det är allt. jag vet inte vad som hände.",
    "da": "han blev født i byen og boede der længe. hun var søster til forfatteren. filmen udkom først. de kommer ikke fra det samme land. ifølge teksten levede han længere end de andre. svaret på spørgsmålet er ikke kendt. hendes mormor hed sådan.",
    "pl": "ona urodziła się w mieście i mieszkała tam długo. on był bratem pisarza. film ukazał się jako pierwszy. nie pochodzą z tego samego kraju. według tekstu żył dłużej niż inni. odpowiedź na pytanie nie jest znana. jego babcia nazywała się tak. to była siostra króla.",
    "cs": "narodil se ve městě a žil tam dlouho. byla to sestra spisovatele. film vyšel jako první. nepocházejí ze stejné země. podle textu žil déle než ostatní. odpověď na otázku není známa. jeho babička se jmenovala takto.",
    "tr": "onun büyükannesi idi ve bu kentinde yaşadı. şehirde doğdu ve orada uzun süre yaşadı. film önce çıktı. aynı ülkeden gelmiyorlar. metne göre diğerlerinden daha uzun yaşadı. sorunun cevabı bilinmiyor. yazarın kız kardeşiydi.",
    "fi": "hän syntyi kaupungissa ja asui siellä kauan. elokuva ilmestyi ensin. he eivät ole samasta maasta. tekstin mukaan hän eli pidempään kuin muut. vastausta kysymykseen ei tiedetä. hänen isoäitinsä nimi oli tämä.",
    "hu": "a városban született és sokáig ott élt. a film jelent meg először. nem ugyanabból az országból jönnek. a szöveg szerint tovább élt mint a többiek. a kérdésre adott válasz nem ismert. a nagyanyját így hívták.",
    "ro": "s-a născut în orașul și a trăit acolo mult timp. bunica lui se numea așa. filmul a apărut primul. nu sunt din aceeași țară. potrivit textului a trăit mai mult decât ceilalți. răspunsul la întrebare nu este cunoscut.",
    "id": "dia lahir di kota dan tinggal di sana untuk waktu yang lama. film itu keluar lebih dulu. mereka tidak berasal dari negara yang sama. menurut teks dia hidup lebih lama dari yang lain. jawaban untuk pertanyaan itu tidak diketahui.",
    "ru": "он родился в городе и долго там жил. это была сестра писателя. фильм вышел первым. они не из одной страны. согласно тексту он жил дольше других. ответ на вопрос неизвестен. его бабушку звали так.",
    "uk": "він народився у місті і довго там жив. це була сестра письменника. фільм вийшов першим. вони не з однієї країни. згідно з текстом він жив довше за інших.",
    "el": "γεννήθηκε στην πόλη και έζησε εκεί για πολύ καιρό. η ταινία βγήκε πρώτη. δεν είναι από την ίδια χώρα. σύμφωνα με το κείμενο έζησε περισσότερο από τους άλλους.",
    "ar": "وُلد في مدينة وعاش هناك طويلا. صدر الفيلم أولا. ليسا من نفس البلد. حسب النص عاش أطول من الآخرين. كانت أخت الكاتب. الجواب غير معروف.",
    "he": "הוא נולד בעיר וחי שם זמן רב. הסרט יצא ראשון. הם לא מאותה מדינה. לפי הטקסט הוא חי יותר מהאחרים.",
    "hi": "उनका जन्म शहर में हुआ था और वे वहाँ लंबे समय तक रहे। फिल्म पहले आई। वे एक ही देश से नहीं हैं।",
    "zh": "他出生在这个城市，在那里住了很久。这部电影先上映。他们不是同一个国家的人。根据文章，他活得更久。",
    "ja": "彼はその町で生まれ、長くそこに住んでいました。映画は先に公開されました。二人は同じ国の出身ではありません。",
    "ko": "그는 그 도시에서 태어나 오랫동안 그곳에 살았습니다. 영화가 먼저 개봉했습니다. 두 사람은 같은 나라 출신이 아닙니다.",
}
#: Frequent finite verbs and participles: a text of the language without any is no clause.
CLAUSE = {
    "en": "is was were are be been has have had did does do must may might could would should lived lives born died dies came comes come says said appears released directed wrote called named",
    "de": "ist war waren sind sei wäre wurde wurden wird hat hatte hatten haben lebte lebten kam kamen kommt kommen starb starben heißt hieß erschien erschienen gehört führte führten schrieb stammt stammen stammte geboren kann konnte muss musste gibt gab liegt lag",
    "fr": "est était étaient sont fut furent a ont avait avaient c'est c'était s'appelait s'appelle n'est n'a vient viennent venait venaient né née mort vécut vécu sorti sortie réalisé réalisa écrit habitait habite peut doit il elle ils elles",
    "it": "è era erano fu furono ha hanno nacque nato nata morì visse venne vengono viene chiamava chiamavano uscito uscì sono",
    "pt": "é era eram foi foram tem têm nasceu morreu viveu veio saiu chamava está são",
    "nl": "is was waren zijn werd werden wordt heeft had hebben woonde leefde stierf kwam komen heette",
    "sv": "är var blev har hade föddes bodde levde dog kom kommer hette",
    "da": "er var blev har havde født boede levede døde kom kommer hed udkom",
    "es": "es era eran son fue fueron ha han había habían nació nacieron murió murieron vivió vivieron salió salieron llama llamaba llamaban viene vienen dirigió escribió está estaba están tiene tuvo puede debe",
}
_LEAD = (
    r"(?:the |die |la |a |an )?(?:final |short |correct |richtige )?(?:answer|ans|a|reply|response|result|antwort|respuesta|réponse|reponse)"
    r"(?: (?:to (?:this|the|your) question|here))?\s*(?:is|ist|es|est|are|would be|:|-|–|=)*"
)
_EMPTY = re.compile(rf"(?i)^\W*(?:(?:{_LEAD}|it is|es ist|sure|okay|ok|well|here is|here's|based on the (?:context|passages?|text))[\W_]*)*$")
_END_MARKS = re.compile(r"(?i)</?s>|<\|[a-z_]+\|>|<eos>|<pad>|\[/?(?:end|eos|inst|unk)\]|\[(?:end of text)\]|<end_of_turn>")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_QUOTED = re.compile(r"(?i)^\W*(?:(?:q|question|you asked|the question (?:was|is)|frage|pregunta|answer|ans|a|antwort|respuesta)\s*:\W*)+")
REFUSALS = re.compile(
    "|".join(
        (
            r"\bi ?(?:really |just |also )?(?:can(?:no|')t|cannot|could(?: not|n't)|am (?:not able|unable)|'m (?:not able|unable)|won't be able|will not be able|do(?: not|n't) know|do(?: not|n't) have (?:access|enough|any|the|that)|must decline|have to decline|decline to|would rather not|'d rather not|prefer not)\b",
            r"\b(?:not|isn't|insufficient|too little|lack of) (?:enough |sufficient )?(?:information|evidence|context|data|detail)s?\b(?! (?:office|society|press))",
            r"\b(?:gives?|provides?|contains?|offers?) no (?:answer|information|indication|clue|details?)\b|\bno information\b|\bno answer (?:is|can|could|was)\b",
            r"\b(?:does|do|did) not (?:mention|say|state|specify|tell|appear in|contain|provide|give|answer|cover)\b|\bdoesn't (?:mention|say|state|specify|appear|contain|provide|give|answer)\b",
            r"\bno (?:passage|source|text|document|paragraph|excerpt)s? (?:says?|mentions?|states?|tells?|gives?|lets?)\b|\bnone of the (?:passages|sources|texts|documents|paragraphs|excerpts)\b|\bnothing in the (?:passages?|sources?|texts?|documents?|paragraphs?|excerpts?|context)\b",
            r"\b(?:cannot|can't|can not|could not) be (?:determined|resolved|answered|known|established|inferred|decided|derived)\b|\bimpossible to (?:say|tell|know|determine|answer)\b|\b(?:not|isn't) (?:specified|stated|mentioned|known|given) (?:anywhere|in the)\b",
            r"\b(?:are|is) silent (?:on|about)\b|\b(?:more|further) (?:details?|information|context|evidence) (?:would be |is |are )?(?:needed|required|necessary)\b|\blies? outside what i\b|\b(?:let|lets|allow|allows|help|helps) me (?:work|find|figure) (?:this|that|it) out\b",
            r"\b(?:unanswerable|as an? (?:ai|language) model)\b",
            r"\bkann ich (?:leider |dazu |so )?(?:nicht|keine)\b|\bich (?:kann|weiß|darf|möchte) (?:\w+ ){0,4}(?:nicht|keine)\b|\b(?:enthält|enthalten|gibt|geben|liefert|nennt) (?:\w+ ){0,2}keine\b|\bliegen (?:\w+ ){0,3}keine\b|\blässt sich (?:\w+ ){0,4}nicht\b|\bgeht (?:\w+ ){0,4}nicht hervor\b|\bkeine (?:angaben?|informationen|auskunft|antwort)\b",
            r"\bno (?:puedo|sé|es posible|se puede|dispongo|tengo|contiene|hay (?:información|datos|suficiente)|se menciona|consta|aparece|ofrece|dice)\b|\bsin (?:más )?información\b|\blo siento\b",
            r"\bje ne (?:peux|sais|dispose|connais|suis pas)\b|\b(?:ne (?:contient|mentionne|précise|permet|donne) (?:pas|aucun))|\baucune (?:information|réponse|donnée)\b|\bn'est pas (?:possible|précisé|mentionné)\b|\bil est impossible\b",
        )
    )
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: What joins the capitalised words of one name or title.
_IDEOGRAPHS = re.compile("([぀-ヿ㐀-鿿가-힣]+)")
_JOINTS = {"of", "for", "and", "the"}
_NAME = re.compile(r"\b[^\W\d_a-z][^\W\d_]*")
_OPEN = re.compile(r"[-,;:(\[{«“–—]$")
_STOP = re.compile(r"[.!?…\"'”’»)\]*。！？]\s*$")


_CLAUSE_WORDS = {w for words in CLAUSE.values() for w in words.split()}


def without_names(text: str) -> str:
    """The words of running text in lower case: no capitalised words (but for the first of a sentence,
    if a word in lower case follows), nor what joins them, nor numbers."""
    text = _IDEOGRAPHS.sub(r" \1 ", text)
    words = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    name = []
    for k, (w, at) in enumerate(words):
        if not w[0].isupper():
            name.append(w[0].isdigit())
            continue
        first = k == 0 or re.search(r"[.!?:\n¿¡\"“]\s*[¿¡\"“]?$", text[words[k - 1][1] : at]) is not None
        follows = k + 1 < len(words) and not words[k + 1][0][0].isupper() and not words[k + 1][0][0].isdigit()
        kept = first and (follows or w.lower().replace("’", "'") in _CLAUSE_WORDS)
        name.append(not kept)
    for k, (w, _) in enumerate(words):
        if not name[k] and w in _JOINTS and k and name[k - 1]:
            j = k
            while j < len(words) and not name[j] and words[j][0] in _JOINTS:
                j += 1
            if j < len(words) and name[j]:
                for i in range(k, j):
                    name[i] = True
    return " ".join(w.lower().replace("’", "'") for (w, _), n in zip(words, name) if not n)


#: What a character is; those of ``_KINDS`` are looked up when they are first met.
(WORD, UPPER, DIGIT, SPACE, MARK, JOINED, IDEOGRAPH, LETTER, CAPITAL, DECIMAL, GROWS, BOUND, MET) = (1 << k for k in range(13))
_KINDS, _UPPER = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _kinds(codes: np.ndarray) -> np.ndarray:
    kinds = _KINDS[codes]
    new = np.unique(codes[kinds == 0]).tolist()
    for c in map(chr, new):
        letter = c.isalnum() and not c.isdecimal()
        is_it = {
            WORD: c.isalnum(), UPPER: c.isupper(), DIGIT: c.isdigit(), SPACE: c.isspace(), MARK: c in '.!?:\n¿¡"“', JOINED: c in "'’", IDEOGRAPH: _IDEOGRAPHS.match(c),
            LETTER: letter, CAPITAL: letter and not "a" <= c <= "z", DECIMAL: c.isdecimal(), GROWS: len(c.upper()) > 1, BOUND: not (c.isalnum() or c == "_"), MET: True,
        }
        _KINDS[ord(c)] = sum(k for k, it in is_it.items() if it)
        _UPPER[ord(c)] = ord(c.upper()[0])
    return _KINDS[codes] if new else kinds


def _within(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places are in a stretch from ``first`` to before ``last``; none meet."""
    edges = np.zeros(n + 1, np.int8)
    edges[first] += 1
    edges[last] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8) > 0


def all_without_names(texts: list[str]) -> list[str]:
    """``without_names`` of each, over the characters of many at once."""
    return [t for part in _slices(texts, BLOCK) for t in _without_names(part)]


def _without_names(texts: list[str]) -> list[str]:
    text = "\n".join(texts) + "\n"
    codes = _codes(text)
    kind, ends = _kinds(codes), np.cumsum([len(t) + 1 for t in texts])
    inside = (kind & WORD) > 0
    joined = np.flatnonzero(kind & JOINED)
    inside[joined[inside[joined - 1] & inside[joined + 1]]] = True  # the last character is a line end
    edge = np.diff(inside.view(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n, of = len(start), np.searchsorted(ends, start, "right")
    head, tail = np.diff(of, prepend=-1) != 0, np.diff(of, append=-1) != 0
    upper, named = (kind[start] & UPPER) > 0, (kind[start] & (UPPER | DIGIT)) > 0
    # the first of a sentence: a mark stands before it, or a line end in the white space before it
    at = np.arange(len(codes), dtype=np.int32)
    solid = np.maximum.accumulate(np.where(kind & SPACE, -1, at))[start - 1]
    lines = np.maximum.accumulate(np.where(codes == 10, at, -1))[start - 1]
    first = upper & (head | (lines > solid) | ((kind[solid] & MARK) > 0))
    follows = ~tail & np.append(~named[1:], False)[:n]
    kept = first & follows
    for k in np.flatnonzero(first & ~follows).tolist():
        kept[k] = text[start[k] : stop[k]].lower().replace("’", "'") in _CLAUSE_WORDS
    named &= ~kept
    joint = np.zeros(n, bool)
    for w in _JOINTS:
        k = np.flatnonzero(stop - start == len(w))
        for i, c in enumerate(w):
            k = k[codes[start[k] + i] == ord(c)]
        joint[k] = True
    opens, closes = np.flatnonzero(joint & (head | ~np.roll(joint, 1))), np.flatnonzero(joint & (tail | ~np.roll(joint, -1)))
    between = ~head[opens] & ~tail[closes] & named[opens - 1] & named[(closes + 1) % max(1, n)]
    named |= _within(opens[between], closes[between] + 1, n)
    # words one blank apart, a line for each text
    start, stop, of = start[~named], stop[~named], of[~named]
    blank = stop[:-1][of[:-1] == of[1:]]
    out, there = codes.copy(), _within(start, stop, len(codes))
    out[blank], there[blank], there[ends - 1] = 32, True, True
    rest = _text(out[there]).lower().replace("’", "'").split("\n")[:-1]
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(kind & IDEOGRAPH), "right")).tolist():
        rest[k] = without_names(texts[k])
    return rest


class Languages:
    """Naive Bayes over character n-grams. ``texts`` are (language, source, text); the sources of
    a language weigh alike, and so do the languages, whatever their numbers of texts. ``counted``: the n-grams of
    each language's corpus, a source of its own."""

    SCALE, SMOOTH, UNKNOWN = 20_000, 0.2, "unknown"

    def __init__(self, texts: list[tuple[str, str, str]], counted: dict[str, Counter] | None = None) -> None:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for language, c in (counted or {}).items():
            counts[language]["corpus"] = c
        for language, source, text in texts:
            counts[language][source].update(self.grams(text))
        self.languages = sorted(counts) + [self.UNKNOWN]
        self.index = {g: k for k, g in enumerate(sorted({g for sources in counts.values() for c in sources.values() for g in c}))}
        total = math.log(self.SCALE + self.SMOOTH * (len(self.index) + 1))
        # a row for each n-gram, the last one for any other
        self.table = np.full((len(self.index) + 1, len(self.languages)), math.log(self.SMOOTH) - total)
        for k, language in enumerate(self.languages[:-1]):
            mixed: Counter = Counter()
            for c in counts[language].values():
                scale = self.SCALE / len(counts[language]) / max(1, sum(c.values()))
                for g, n in c.items():
                    mixed[g] += n * scale
            for g, n in mixed.items():
                self.table[self.index[g], k] = math.log(n + self.SMOOTH) - total
        self.table[:, -1] = -math.log(OPEN_GRAMS)
        self.keys = pa.array([sum(ord(c) + 1 << 21 * k for k, c in enumerate(g)) for g in self.index], pa.int64())

    @staticmethod
    def grams(text: str) -> list[str]:
        padded = f" {text} "
        return [padded[k : k + n] for n in range(1, N_GRAM + 1) for k in range(len(padded) - n + 1)]

    def scores(self, text: str) -> dict[str, float]:
        last = len(self.index)
        rows = np.fromiter((self.index.get(g, last) for g in self.grams(text)), np.int64)
        return dict(zip(self.languages, (self.table[rows].sum(axis=0) / N_GRAM).tolist()))

    def all_scores(self, texts: list[str]) -> Iterator[dict[str, float]]:
        """``scores`` of each; the n-grams of many are looked up at once."""
        last = len(self.index)
        for part in _slices(texts, BLOCK):
            codes, rows = _codes("".join(f" {t} " for t in part)).astype(np.int64) + 1, []
            key = np.zeros(len(codes), np.int64)
            for n in range(N_GRAM):
                key = key[: len(codes) - n] | codes[n:] << 21 * n
                rows.append(pc.index_in(pa.array(key), value_set=self.keys).fill_null(last).to_numpy())
            at = 0
            for t in part:
                end = at + len(t) + 2
                own = np.concatenate([r[at : end - n] for n, r in enumerate(rows)])
                yield dict(zip(self.languages, (self.table[own].sum(axis=0) / N_GRAM).tolist()))
                at = end


class Ends:
    """Log odds that a text which stops here was cut off.

    ``complete`` are texts that end where they should, whose insides show how cut texts end, ``closing`` ends
    that are complete by their frequency. The share of ends among the places that show the last n characters
    is smoothed by that of the last n - 1; cuts weigh as much as ends on the whole."""

    BASE, MASK, TRUST = 1_000_003, (1 << 64) - 1, 1.0

    def __init__(self, complete: list[str], closing: list[str] = (), least: int = 2) -> None:
        self.learn(zip(*(x.tolist() for x in suffixes(self.bodies(complete)))), closing, least)

    def learn(self, rows: Iterable[tuple[int, int, int, int]], closing: list[str], least: int = 2) -> Ends:
        """``rows``: what ``suffixes`` gives, summed up."""
        rows = list(rows)
        self.texts, n_cuts = next(((e, c) for n, _, e, c in rows if not n), (0, 0))
        self.weight = max(1, self.texts) / max(1, n_cuts)
        self.known = Counter(h for t in closing for h in self.hashes(self.body(t)[-SUFFIX:]))
        self.counts: dict[int, tuple[float, float]] = {}
        for n, h, e, c in rows:
            if n and (it := self.counted(n, h & self.MASK, e, c, least)):
                self.counts[h & self.MASK] = it
        for h in self.known.keys() - self.counts.keys():
            self.counts[h] = self.counted(0, h, 0, 0, least)
        return self

    def counted(self, n: int, h: int, ends: int | None, cuts: int | None, least: int = 2) -> tuple[float, float] | None:
        """Ends and weighed cuts behind the ``n`` characters of hash ``h``; none where they are too rare."""
        e, c = ends or 0, cuts if cuts and cuts >= least else 0
        times = self.known.get(h, 0)
        if not times and e + c < (1 if n == 1 else least):
            return None
        if n > 1 and e + c < least:
            e = c = 0
        return e + times * 0.01 * self.texts, c * self.weight

    @classmethod
    def bodies(cls, complete: Iterable[str]) -> list[str]:
        return [b for b in cls.shapes([cls.bare(t) for t in complete]) if len(b) > 2]

    @staticmethod
    def shape(text: str) -> str:
        """Digits alike, and names in capitals, so that their ends are not those of words in lower case."""
        return _NAME.sub(lambda m: m.group().upper(), re.sub(r"\d", "0", f" {text}"))

    @classmethod
    def shapes(cls, texts: list[str]) -> list[str]:
        """``shape`` of each, over the characters of many at once."""
        return [t for part in _slices(texts, BLOCK) for t in cls._shapes(part)]

    @classmethod
    def _shapes(cls, texts: list[str]) -> list[str]:
        codes = _codes("".join(f" {t}" for t in texts)).copy()
        kind, ends = _kinds(codes), np.cumsum([len(t) + 1 for t in texts])
        edge = np.diff(((kind & LETTER) > 0).view(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        capital = ((kind[start] & CAPITAL) > 0) & ((kind[start - 1] & BOUND) > 0)
        name = _within(start[capital], stop[capital], len(codes))
        codes[name] = _UPPER[codes[name]]
        codes[(kind & DECIMAL) > 0] = ord("0")
        whole = _text(codes)
        out = [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(name & ((kind & GROWS) > 0)), "right")).tolist():
            out[k] = cls.shape(texts[k])
        return out

    @staticmethod
    def bare(text: str) -> str:
        return text.strip().rstrip(".!?…\"'”’»)")

    @classmethod
    def body(cls, text: str) -> str:
        return cls.shape(cls.bare(text))

    @classmethod
    def hashes(cls, text: str) -> list[int]:
        """Of the last 1, 2, ... characters."""
        out, h, power = [], 0, 1
        for c in reversed(text[-SUFFIX:]):
            h, power = h + ord(c) * power & cls.MASK, power * cls.BASE & cls.MASK
            out.append(h)
        return out

    def cut(self, text: str) -> float:
        if _OPEN.search(text):
            return OPEN_ODDS
        return self.odds(self.counts.get(h) for h in self.hashes(self.shape(text)))

    @classmethod
    def odds(cls, counts: Iterable[tuple[float, float] | None]) -> float:
        """From the counts of the last 1, 2, ... characters, up to the first that have none."""
        p = 0.5
        for it in counts:
            if it is None:
                break
            e, c = it
            p = (e + cls.TRUST * p) / (e + c + cls.TRUST)
        return math.log((1 - p + 1e-6) / (p + 1e-6))


def suffixes(bodies: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(n, hash, ends, cuts): how often the last ``n`` characters of each hash stand at the end of ``bodies``, and where these may be
    cut; for n = 0 at all. ``wanted``: a map by the last bits of the hashes that are asked for, each with those of fewer characters."""
    codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(b) for b in bodies], np.int64)
    stops = np.cumsum(sizes)
    at = np.arange(len(codes)) - np.repeat(stops - sizes, sizes)  # place within its text
    is_end = np.zeros(len(codes), bool)
    is_end[stops - 1] = True
    pos = np.flatnonzero(is_end | (codes != 32) & (at > 0))
    out = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(bodies)]), np.array([len(pos) - len(bodies)]))]
    hashed, power = np.zeros(len(pos), np.uint64), np.uint64(1)
    for n in range(1, SUFFIX + 1):
        whole = at[pos] >= n - 1
        pos, hashed = pos[whole], hashed[whole]
        hashed = hashed + codes[pos - (n - 1)] * power
        power = np.uint64(int(power) * Ends.BASE & Ends.MASK)
        if wanted is not None:
            asked = wanted[hashed & np.uint64(len(wanted) - 1)]
            pos, hashed = pos[asked], hashed[asked]
        if not len(pos):
            break
        coded = pa.array(hashed.view(np.int64)).dictionary_encode()
        index, h = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        ends = np.bincount(index[is_end[pos]], minlength=len(h))
        out.append((np.full(len(h), n), h, ends, np.bincount(index, minlength=len(h)) - ends))
    return tuple(map(np.concatenate, zip(*out)))


class Judge:
    """``ends`` may be missing: then only ``judged`` can be asked."""

    def __init__(self, languages: Languages, ends: Ends | None = None) -> None:
        self.languages, self.ends = languages, ends
        self.clause = {m: set(words.split()) for m, words in CLAUSE.items()}

    def other_language(self, question: str, reply: str) -> bool:
        asked, said = without_names(question), without_names(reply)
        return bool(asked) and self.tells(said) and self.differ(self.languages.scores(asked), self.languages.scores(said), said)

    @staticmethod
    def foreign(rest: str) -> bool:
        return not rest.isascii() and any(ord(c) > 0x36F for c in rest)

    @classmethod
    def tells(cls, rest: str) -> bool:
        """Whether these words may have a language at all: two different ones, or foreign letters."""
        return bool(rest) and (len(set(rest.split())) > 1 or cls.foreign(rest))

    def differ(self, wanted: dict[str, float], scores: dict[str, float], rest: str) -> bool:
        """Whether the language of the reply, whose words are ``rest``, is not that of the question."""
        asked, said = max(wanted, key=wanted.get), max(scores, key=scores.get)
        if asked == said or min(scores[said] - scores[asked], wanted[asked] - wanted[said]) < LANGUAGE_ODDS:
            return False
        words = set(rest.split())
        if said in self.clause:
            return len(words) > 1 and bool(self.clause[said] & words)
        return self.foreign(rest) or len(words) > 1 and said != Languages.UNKNOWN

    @staticmethod
    def copies(question: str, reply: str) -> bool:
        asked = [w.lower() for w in _WORD.findall(question)]
        said = [w.lower() for w in _WORD.findall(_QUOTED.sub("", reply))]
        n = len(asked)
        if n < 3 or len(said) < COPY_SHARE * n or not set(said) <= set(asked):
            return False
        asked, said = Counter(asked), Counter(said)
        if not said - asked:
            return True
        twice = Counter({w: 2 * k for w, k in asked.items()})
        return sum(said.values()) >= (1 + COPY_SHARE) * n and not said - twice

    @staticmethod
    def needed(body: str, gold: str | None, question: str) -> float | None:
        """The odds of a cut from which the reply is truncated; none if it is whole anyway."""
        if _STOP.search(body):
            return None
        low, g, shift = body.lower(), (gold or "").strip().lower().rstrip("."), 0.0
        words = [(m.group(), m.start()) for m in _WORD.finditer(low)]
        if g and low.endswith(g):
            shift = WHOLE_REFERENCE
        elif g and words and low[-1].isalnum():
            # a start of the reference answer stands last, and that goes on inside the word or after running text
            starts = [low[at:] for _, at in words[-8:]]
            if any(3 <= len(t) < len(g) and g.startswith(t) and (g[len(t)].isalnum() or len(words) > 2) for t in starts):
                return NAME_ODDS - INSIDE_REFERENCE
        if len(words) == 1 and body.isalnum():
            return None  # one word alone
        last = body.split()[-1]
        if last[:1].islower() or not last[-1].isalnum():
            return CUT_ODDS - shift
        asked = {w.lower() for w in _WORD.findall(question)}
        if words and words[-1][0] in asked:
            shift += KNOWN_NAME
        elif words and any(len(words[-1][0]) >= 3 and w.startswith(words[-1][0]) for w in asked):
            shift += INSIDE_QUESTION
        return NAME_ODDS - shift

    def defect(self, question: str | None, reply: str | None, gold: str | None) -> str | None:
        defect, body, need = self.judged(question, reply, gold)
        return "truncated" if need is not None and self.ends.cut(body) >= need else defect

    def judged(self, question: str | None, reply: str | None, gold: str | None) -> tuple[str | None, str, float | None]:
        """The defect but for truncation; else what is said, and the odds of a cut from which it is truncated."""
        defect, said = self.plain(question, reply)
        if not defect and question and self.other_language(question, said):
            defect = "other_language"
        body = said.rstrip()
        return defect, body, None if defect else self.needed(body, gold, question or "")

    def all_judged(self, questions: list[str | None], replies: list[str | None], golds: list[str | None]) -> Iterator[tuple[str | None, str, float | None]]:
        """``judged`` of each; languages are told for all at once."""
        plain = [self.plain(q, r) for q, r in zip(questions, replies)]
        open_ = [k for k, (defect, _) in enumerate(plain) if not defect and questions[k]]
        rests = zip(open_, all_without_names([questions[k] for k in open_]), all_without_names([plain[k][1] for k in open_]))
        rests = [(k, asked, said) for k, asked, said in rests if asked and self.tells(said)]
        scored = zip(rests, self.languages.all_scores([x[1] for x in rests]), self.languages.all_scores([x[2] for x in rests]))
        other = {k for (k, _, rest), wanted, scores in scored if self.differ(wanted, scores, rest)}
        for k, (question, (defect, said), gold) in enumerate(zip(questions, plain, golds)):
            body = said.rstrip()
            if k in other:
                defect = "other_language"
            yield defect, body, None if defect else self.needed(body, gold, question or "")

    def plain(self, question: str | None, reply: str | None) -> tuple[str | None, str]:
        """The defect but for languages and truncation, and what is said."""
        said = reply or ""
        if "<" in said or "[" in said:
            said = _END_MARKS.sub(" ", said)
        said = (said if said.isascii() else _INVISIBLE.sub("", said)).strip()
        if _EMPTY.match(said):
            return "empty", said
        asked = question or ""
        if asked and self.copies(asked, said):
            return "copies_question", said
        running = said[0].lower() + said[1:]
        running = re.sub(r"(?<=[.:!?,] )[A-Z](?=[a-z]+ [a-z])|\bI\b(?= [a-z'])|\bI\b(?=['’])", lambda m: m.group().lower(), running).replace("’", "'")
        if REFUSALS.search(running):
            return "refusal", said
        return None, said


def _sentences(df: DataFrame) -> DataFrame:
    """(``lang``, text): whole sentences with a stop of the texts of ``df``."""
    cut = df.select("lang", F.explode(F.split("text", r"[\r\n]+|(?<=[.!?])\s+")).alias("text"))
    return cut.select("lang", F.trim("text").alias("text")).filter(F.length("text").between(20, 400) & F.col("text").rlike(r"[.!?]$"))


def _replies(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.lit("").alias("lang"), F.coalesce("raw_response", "answer").alias("text")).filter("text is not null")


def _closing(replies: DataFrame) -> list[str]:
    """Ends without a stop, of two words, that ``CLOSING_SHARE`` of all replies have, at most 1 / ``CLOSING_SHARE``."""
    tail = F.substring(F.concat(F.lit(" "), F.trim("text")), -4 * SUFFIX, 4 * SUFFIX)
    tail = F.concat(F.lit(" "), F.regexp_extract(F.regexp_replace(tail, r"\d", "0"), r"(?:\S+\s+)?\S+$", 0))
    ends = replies.filter(~F.col("text").rlike(r"[.!?]\W*$") & (F.trim("text") != "")).groupBy(tail.alias("tail")).agg(F.count("*").alias("n"))
    least = max(20, int(CLOSING_SHARE * replies.count()))
    return [r["tail"] for r in ends.filter(F.col("n") >= least).toLocalIterator()]


def _slices(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _summed(batches: Iterator[pa.RecordBatch], keys: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, those of the same keys together as far as they are held."""
    held, rows = [], 0

    def together() -> pa.Table:
        t = pa.Table.from_batches(held).group_by(keys).aggregate([(x, "sum") for x in sums])
        return t.select([*keys, *(f"{x}_sum" for x in sums)]).rename_columns([*keys, *sums]).combine_chunks()

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= HELD:
            t = together()
            if 2 * t.num_rows > HELD:
                yield from t.to_batches(max_chunksize=100_000)
                t = t.slice(0, 0)
            held, rows = t.to_batches() or [b.slice(0, 0)], t.num_rows
    if held:
        yield from together().to_batches(max_chunksize=100_000)


def _grams(texts: list[str]) -> list[tuple[pa.Array, pa.Array]]:
    """As the n-grams of ``Languages``, by number: 21 bits for each character and one."""
    text = "".join(f" {t} \n" for t in texts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends, counts = np.cumsum([len(t) + 3 for t in texts]), []
    left = np.repeat(ends - 1, np.diff(ends, prepend=0)) - np.arange(len(codes))  # characters up to the end of its text
    key = np.zeros(len(codes), np.int64)
    for n in range(1, N_GRAM + 1):
        key = key[: len(codes) - n + 1] | (codes[n - 1 :] + 1) << 21 * (n - 1)
        counts.append(pa.array(key[left[: len(key)] >= n]).value_counts())
    return [(c.field("values"), c.field("counts")) for c in counts]


def languages(documents: DataFrame) -> Languages:
    """Fitted on all sentences of ``documents`` with a language, whose label may be in any letter case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by = defaultdict(list)
                langs, texts = (batch.column(c).to_pylist() for c in ("lang", "text"))
                for lang, text in zip(langs, all_without_names(texts)):
                    by[lang].append(text)
                for lang, texts in by.items():
                    for part in _slices(texts):
                        for key, times in _grams(part):
                            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(key), np.int64))), key, times], names=["lang", "gram", "times"])

        yield from _summed(each(), ["lang", "gram"], ["times"])

    labelled = _sentences(documents.filter("text is not null and lang <> ''").select(F.lower("lang").alias("lang"), "text"))
    rows = widen(labelled).mapInArrow(run, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    counted: dict[str, Counter] = defaultdict(Counter)
    for r in rows.collect():  # as many as the letters of the languages make
        gram = "".join(chr((r["gram"] >> 21 * k & 0x1FFFFF) - 1) for k in range(N_GRAM) if r["gram"] >> 21 * k)
        counted[r["lang"]][gram] = r["times"]
    # every language of the clause lists has at least its verbs
    return Languages([(m, "words", t) for words in (SAMPLES, CLAUSE) for m, t in words.items()], counted)


def end_counts(documents: DataFrame, predictions: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """What ``suffixes`` counts over all sentences of documents and replies and all reference answers."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(Ends.bodies(batch.column("text").to_pylist())):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in suffixes(part, shared.value)], names=["n", "h", "ends", "cuts"])

        yield from _summed(each(), ["n", "h"], ["ends", "cuts"])

    docs = documents.filter("text is not null").select(F.lit("").alias("lang"), "text")
    gold = predictions.filter("gold_answer <> ''").select(F.substring("gold_answer", -400, 400).alias("text"))
    complete = _sentences(docs).select("text").unionByName(_sentences(_replies(predictions)).select("text")).unionByName(gold)
    return widen(complete).mapInArrow(run, "n long, h long, ends long, cuts long").groupBy("n", "h").agg(F.sum("ends").alias("ends"), F.sum("cuts").alias("cuts"))


def fit(documents: DataFrame, predictions: DataFrame) -> Judge:
    """Both classifiers whole on the driver, for tables of which all n-grams have room there. ``defects`` needs no such room."""
    ends = Ends([]).learn(map(tuple, end_counts(documents, predictions).collect()), _closing(_replies(predictions)))
    return Judge(languages(documents), ends)


def _odds(undecided: DataFrame, documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """(tail, odds) of each last characters that replies have, by the whole ends model."""

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, n, h - (h >> 63 << 64)) for t in batch.column("tail").to_pylist() for n, h in enumerate(Ends.hashes(t), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], names=["tail", "n", "h"])

    asked = written(undecided.select("tail").distinct().mapInArrow(spelt, "tail string, n long, h long"))
    bit = F.col("h").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    parts = asked.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    wanted = np.zeros((1 << MAP_BITS - 15, 1 << 15), bool)
    for r in parts.collect():
        wanted[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    counts = written(end_counts(documents, predictions, wanted.ravel()))
    ends = Ends([]).learn(map(tuple, counts.filter("n = 0").collect()), _closing(_replies(predictions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, odds = batch.column("tail").to_pylist(), []
            for tail, found in zip(tails, batch.column("found").to_pylist()):
                of = {x["n"]: (x["ends"], x["cuts"]) for x in found}
                odds.append(Ends.odds(ends.counted(n, h, *of.get(n, (0, 0))) for n, h in enumerate(Ends.hashes(tail), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(tails, pa.string()), pa.array(odds, pa.float64())], names=["tail", "odds"])

    met = asked.join(counts, ["n", "h"], "left").groupBy("tail").agg(F.collect_list(F.struct("n", "ends", "cuts")).alias("found"))
    return met.mapInArrow(run, "tail string, odds double")


def defects(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """(pred_id, defect) of every defective row."""
    judge = predictions.sparkSession.sparkContext.broadcast(Judge(languages(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, *columns = (batch.column(c).to_pylist() for c in ("pred_id", "question", "reply", "gold_answer"))
            judged = list(judge.value.all_judged(*columns))
            for k, (defect, body, need), shape in zip(ids, judged, Ends.shapes([body for _, body, _ in judged])):
                tail = None
                if need is not None:
                    if not _OPEN.search(body):
                        tail = shape[-SUFFIX:]
                    elif need <= OPEN_ODDS:
                        defect = "truncated"
                if defect or tail is not None:
                    rows.append((k, defect, tail, need))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["pred_id", "defect", "tail", "need"])

    reply = F.coalesce("raw_response", "answer").alias("reply")
    rows = widen(predictions.select("pred_id", "question", reply, "gold_answer"))
    judged = written(rows.mapInArrow(run, "pred_id long, defect string, tail string, need double"))
    undecided = judged.filter("tail is not null").select("pred_id", "tail", "need")
    cut = undecided.join(_odds(undecided, documents, predictions), "tail").filter("odds >= need").select("pred_id", F.lit("truncated").alias("defect"))
    return judged.filter("defect is not null").select("pred_id", "defect").unionByName(cut)
