"""Template residue, filler, error messages and script notices.

Every document is cut into units (lines and sentences), in which addresses, dates, numbers and identifiers
are masked. The exact hashes of the masked units are grouped over all documents and sources, so that a
message is one group however often it was served and whatever it was served with. Each group is
classed once by phrase rules as error message, script notice or filler, and the classes go back to
the documents by hash. What recurs widely (in ``WIDE_DOCS`` documents of several sources) counts for
more: a recurring follow-up of a message ("please try again") is a message of its own, and a short
recurring unit that no rule claims is page furniture (navigation, notices of rights), which says nothing
about its document. A unit that stands in one document only is classed by the same rules.

Placeholder rules look at the whole raw text. A document is residue if it holds an unfilled placeholder, or
if at least ``MAIN_SHARE`` of its letters, furniture and a leading title apart, are in classed units.

Counts leave each task as one row a message. Of the classes only those that more than ``HOT_SHARE`` of all
documents have are broadcast, at most (units per document) / ``HOT_SHARE`` of them at any corpus size; the
others are joined by hash, where no key then has more than that share of the documents.

Defined results: null, empty and blank texts are no residue (they hold nothing); a document whose
units are all furniture is none either; repeated texts are judged alike; a null source is a source; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import widen, written

#: Share of a document's letters from which classed units are its main content.
MAIN_SHARE = 0.5
#: A message recurs widely if it stands in so many documents, of more than one source.
WIDE_DOCS = 10
#: A longer unit is running text and no furniture, however often it recurs.
FURNITURE_CHARS = 80
#: Classes of messages in more than this share of all documents are broadcast.
HOT_SHARE = 0.001

_ID = r"[A-Za-z][A-Za-z0-9_.-]*(?: [A-Za-z][A-Za-z0-9_.-]*){0,3}"
_FIELD = (
    r"(?:name|title|date|year|month|day|time|place|city|town|country|state|address|spouse|publisher|director|author|editor|artist|"
    r"question|answer|entity|person|company|organi[sz]ation|subject|topic|text|content|description|summary|number|amount|price|"
    r"email|phone|url|link|image|user|customer|product|position|role|location|birthplace|language)"
)
#: A field's name in any usual spelling; a capitalised word only if it is a usual field.
_FIELD_ID = rf"(?:[a-z]+(?:[_ ][a-z]+)*|[A-Z]{{2,}}(?:[_ ][A-Z]+)*|[A-Z][a-z]+(?:[A-Z][a-z]+)+|(?i:{_FIELD}))"
#: Placeholder rules by a sign that every form of the rule contains; a rule is tried only where its sign stands.
PLACEHOLDERS = [
    ("{", rf"\{{\{{\{{?\s*(?:[#/^>!&]\s*)?(?:(?:if|unless|each|with) )?{_ID}\s*(?:\|[^{{}}]{{0,40}})?\}}\}}"),
    ("{%", r"\{%[-+]?\s*[a-z]+\b[^%{}]{0,60}%\}"),
    ("<%", r"<%[=-]?[^%<>]{1,60}%>"),
    ("{", rf"[$#]\{{\s*{_ID}\s*\}}"),
    ("{", rf"(?<![{{$#%\w\\])\{{{_ID}\}}(?!\}})"),
    ("%(", rf"%\({_ID}\)[sdif]"),
    ("%", rf"(?<![\d%])%{_ID}%(?![\w%])"),
    ("@@", rf"@@{_ID}@@"),
    ("~~", rf"~~{_ID}~~"),
    ("$$", rf"\$\${_ID}\$\$"),
    ("<<", rf"<<{_ID}>>"),
    ("[[[", rf"\[\[\[{_ID}\]\]\]"),
    ("XX_", rf"\bXX_{_ID}_XX\b"),
    ("__", rf"(?<![\w_])__{_FIELD_ID}__(?![\w_])"),
    ("[", r"\[(?i:insert|enter|add)\b[^\[\]]{1,60}\]|\[(?i:your)\s[^\[\]]{1,40}\s(?i:here)\]"),
    ("[", r"\[[^\[\]]{1,40}\s(?i:to be added|to be announced|to be confirmed|goes here|placeholder|tbd|tba)\]"),
    ("<", r"<(?i:enter|insert|your)\s[^<>]{1,40}>"),
    ("&lt;", rf"&lt;(?!(?i:b|i|u|p|a|br|em|strong|div|span|ref|sup|sub|ul|ol|li|table|tr|td|th|h[1-6]|img|code|pre|html|head|body|script|noscript|blockquote)&gt;)(?:(?i:enter |insert |your ))?{_FIELD_ID}&gt;"),
    ("<", r"<(?:[A-Z]{2,}(?:_[A-Z]+)*|[a-z]+(?:_[a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]+)+)>"),
    ("TB", r"[(\[]\s*TB[ADC]\b[^()\[\]]{0,60}[)\]]|\bTB[ADC]\s*:"),
    ("TODO", r"\bTODO\b[:\s]\s*(?:(?i:fill|add|insert|complete|replace|write|enter|put|supply)\b|\w+_\w+)|[(\[]\s*TODO\b[^()\[\]]{0,60}[)\]]"),
    ("FIXME", r"\bFIXME\b"),
]

_THING = r"(?:page|entry|url|link|site|website|content|resource|document|file|address|article|location|server|service|request)"
ERRORS = [
    rf"\b{_THING}\b[^.]{{0,60}}\b(?:could not be found|cannot be found|was not found|not found|does(?:n't| not) exist|no longer exists?|(?:can't|cannot|could not) be (?:displayed|reached|opened|loaded)|(?:is )?temporarily unavailable|(?:has|have) (?:been )?(?:moved|deleted|removed)|is (?:not available|unavailable|down)\b)[^.]{{0,25}}\.?$",
    r"^(?:http |error )*(?:error )?(?:# ?)?[-:.]? ?(?:not found|forbidden|gone|bad gateway|bad request|service unavailable|gateway time-?out|internal server error|too many requests|unauthori[sz]ed|method not allowed|request time-?out)[.!]?$",
    r"\"status\": ?#, ?\"error\"|\"error\": ?\"|^request #",
    r"^too many requests\b|^slow down and retry|^error establishing an? |^log ?in (?:is )?required|^fatal error: |\buncaught \w*(?:error|exception)\b",
    r"^nothing was found (?:at this location|here)|^access (?:is )?denied|^you do not have (?:the )?(?:permission|access)|^your session has (?:expired|timed out)|^please log ?in again",
    r"^(?:the |this |our )?(?:service|site|website|server) is (?:currently )?(?:down|unavailable|under maintenance)|^(?:we(?:'ll| will) be )?back soon|^an? (?:unexpected|internal|unknown) error (?:has )?occurr?ed|^something went wrong",
    r"^the server encountered|unable to complete your request",
    r"^traceback \(most recent call last\)|^file \"[^\"]*\", line #|^at [\w.$]+\([^)]*\)|^(?:[\w.]*(?:error|exception|fault))(?:: .*)?$|^panic: |^(?:warning|fatal error|notice|fatal): [\w:]+\(\)|connection (?:refused|timed out|reset)\b.*$|^segmentation fault|^upstream request time-?out|^retry # of # failed|^giving up$|^stack trace\b|^core dumped",
    r"^(?:interner serverfehler|seite nicht gefunden|zugriff verweigert|die angeforderte seite|ein fehler ist aufgetreten|sie haben keine (?:berechtigung|zugriffsrechte)|sie sind nicht berechtigt|dienst nicht verf.gbar|bitte versuchen sie es sp.ter)",
    r"^(?:page introuvable|erreur (?:interne|du serveur|#)|acc.s refus.|la page demand.e|service indisponible|veuillez r.essayer|une erreur|vous n'avez pas (?:les? droits?|l'autorisation))",
    r"^(?:p.gina no encontrada|error (?:interno|del servidor|#)|acceso denegado|la p.gina (?:solicitada|que busca)|servicio no disponible|no tiene (?:permisos?|autorizaci.n)|int.ntelo (?:de nuevo|m.s tarde)|por favor,? int.ntelo|se ha producido un error)",
]
#: What follows an error message; on its own it proves nothing.
FOLLOW_UPS = [
    r"^(?:please )?(?:return|go back) to the (?:home ?page|main page|previous page)|^please (?:check|try)\b|^try (?:a search|again)|^back to (?:start|home|the)|^the (?:article|page|content) cannot be (?:shown|displayed)|^if this keeps happening|^contact the (?:administrator|webmaster|support)|^oops!?$|^we're sorry[.!]?$|^please wait\b|^(?:compruebe|revise|int.ntelo|vuelva|v.rifiez|r.essayez|retourne[rz]|.berpr.fen|pr.fen|bitte (?:pr.fen|.berpr.fen)|zur.ck zur?)\b|^loading(?:\.\.\.)?$",
]
_SCRIPT = r"(?:java ?script|js|(?:client-side )?script(?:s|ing)|cookies)"
_ENABLE = r"(?:enabled?|activated?|allow(?:ed)?|turn(?:ed)? on|switch(?:ed)? on|requires?|aktivieren(?: sie)?|activer|active|activar|active|habilite|autoriser)"
SCRIPTS = [
    rf"^(?:please |you (?:need|have) to |you must )?{_ENABLE} {_SCRIPT}\b.{{0,80}}$",
    rf"^(?:bitte|veuillez|por favor,?) {_ENABLE} .{{0,20}}{_SCRIPT}\b.{{0,80}}$|^{_ENABLE} {_SCRIPT} (?:en|dans|in) .{{0,60}}$|^{_SCRIPT} muss .{{0,60}}$",
    rf"^(?:this|the|our|sorry,? this) (?:site|page|website|app|viewer|application|content)\b.{{0,60}}\b(?:requires?|needs?|works best with|without)\b ?{_SCRIPT}\b.{{0,40}}$",
    rf"^{_SCRIPT} (?:is|are|must be|seems? to be|has been) (?:disabled|blocked|turned off|switched off|not (?:enabled|supported)|allowed|enabled).{{0,60}}$",
    rf"^(?:we have detected that )?(?:your browser|{_SCRIPT})\b.{{0,40}}(?:does not (?:run|support|allow)|is (?:disabled|blocked)) ?(?:{_SCRIPT})?\b.{{0,60}}$",
    rf"^checking your browser\b|^{_ENABLE} it (?:and reload|in your browser|to (?:run|view|continue|use|see))\b.{{0,60}}$",
]
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad "
    "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt "
    "mollit anim id est laborum"
)
MASH = "asdf asdfg asdfgh asdasd sdfsdf dfgdfg qwer qwert qwerty zxcv zxcvb hjkl jkl fghj aaaa bbbb xxxx aaa xxx abcabc"
#: The lorem word or key roll makes a unit filler if such words are this share of at least so many.
FILLER_SHARE, FILLER_WORDS = 0.6, 4
FILLERS = [
    r"\b(?:title|author|text|content|paragraph|heading|biography|description|name|caption|quote|address|bio)s? goes? (?:here|in this (?:box|space))\b",
    r"^(?:this is )?(?:a )?(?:sample|dummy|placeholder|filler|example|test) (?:text|copy|content|paragraph|entry|page)\b|^replace this (?:text|paragraph|content)|^text for this section (?:will follow|follows)|^add an? \w+ (?:of|about|for) .{0,40} here[.!]?$|\bplease overwrite\b|^please ignore this\b|^(?:test )+(?:# ?)*$|^(?:# )+test\b",
    r"^(?:sub)?heading (?:one|two|three|#)?$|^subheading$|^bullet point (?:one|two|three|four|#)$|^(?:item|section|paragraph) (?:one|two|three|#)$|^blindtext\b|^(?:platzhalter|texte? (?:de remplissage|factice)|texto de (?:relleno|ejemplo))\b|^coming soon[.!]?$|^under construction[.!]?$|^content (?:coming|to follow)\b",
]


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def has_placeholder(text: Column) -> Column:
    """Whether a raw text holds an unfilled placeholder."""
    by_sign: dict[str, list[str]] = {}
    for sign, pattern in PLACEHOLDERS:
        by_sign.setdefault(sign, []).append(pattern)
    out = F.lit(False)
    for sign, patterns in by_sign.items():
        out = out | (F.contains(text, F.lit(sign)) & text.rlike(_any(patterns)))
    return out


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of all brackets."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            c = pattern[at : at + 2]
        elif c == "[":
            c = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", pattern[at:]).group()
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
        at += len(c)
    return out


#: For rules that may match anywhere: how the rule begins, and words of which every match holds one.
WORDS_OF = {
    r"\b(?:page": ("found", "exist", "displayed", "reached", "opened", "loaded", "available", "moved", "deleted", "removed", "down"),
    r"\b(?:title": (" go",),
    r"\"status": ('"status"',),
    r"\"error": ('"error"',),
    r"\buncaught": ("uncaught",),
    r"connection": ("connection",),
    r"\bplease overwrite": ("please overwrite",),
    r"\bplease ignore": ("please ignore",),
    r"unable to complete": ("unable to complete",),
}


def matches(unit: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns is in the unit. Those that can only match at its beginning are one
    pattern that is tried there alone; of the others each is tried where a word stands that it needs."""
    parts = [a for p in patterns for a in _alternatives(p)]
    out = unit.rlike(f"^(?:{_any([a[1:] for a in parts if a[0] == '^'])})")
    for a in (a for a in parts if a[0] != "^"):
        held = F.lit(False)
        for word in next((words for start, words in WORDS_OF.items() if a.startswith(start)), ("",)):
            held = held | F.contains(unit, F.lit(word))
        out = out | (held & unit.rlike(a))
    return out


_LINES = r"\r\n\x0b\x0c\u0085\u2028\u2029"


def _masked(text: Column) -> Column:
    """A text in lower case without markup, its addresses, dates, numbers and identifiers as #; lines
    stay, other white space is one blank."""
    when = lambda sign, f: lambda x: F.when(F.contains(x, F.lit(sign)), f(x)).otherwise(x)
    replace = lambda pattern, by: lambda x: F.regexp_replace(x, pattern, by)
    out = _let(text, when("</", replace(r"</(?:title|h1|p)>", "\n")))
    out = _let(out, when("<", replace(r"</?[A-Za-z][^<>]{0,80}>", " ")))
    entities = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"&(?:nbsp|#160|#9);", " "), r"&(?:quot|#34);", '"'), r"&(?:#39|#x27|apos);", "'")
    out = _let(out, when("&", entities))
    out = _let(out, when("’", lambda x: F.replace(x, F.lit("’"), F.lit("'"))))
    out = F.lower(F.regexp_replace(out, rf"(?U)[\s\x1c-\x1f&&[^{_LINES}]]+", " "))
    addresses = r"\bhttps?://\S*[^\s.!?]|\bwww\.\S*[^\s.!?]|\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
    signs = lambda x: F.contains(x, F.lit("@")) | F.contains(x, F.lit("://")) | F.contains(x, F.lit("www."))
    out = _let(out, lambda x: F.when(signs(x), F.regexp_replace(x, addresses, "#")).otherwise(x))
    return F.regexp_replace(out, r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b(?=[a-f]*\d)[0-9a-f]{6,}\b|\d+", "#")


def units(text: Column) -> Column:
    """Masked units of a text with their places (at, unit), blank ones left out."""
    parts = F.split(_masked(text), rf"[{_LINES}]+|(?<=[.!?]) ")
    return F.filter(F.transform(parts, lambda part, at: F.struct(at.alias("at"), F.trim(part).alias("unit"))), lambda u: u["unit"] != "")


def unit_kind(unit: Column) -> Column:
    """error, script, filler, follow or null for a masked unit."""

    def filler(tokens: Column) -> Column:
        rolled = F.size(F.filter(tokens, lambda w: w.isin(*f"{LOREM} {MASH}".split())))
        repeated = (F.size(tokens) >= 6) & (F.size(F.array_distinct(tokens)) * 4 <= F.size(tokens))
        return (F.size(tokens) >= FILLER_WORDS) & (rolled >= FILLER_SHARE * F.size(tokens)) | repeated

    signs = ".,;:!?()[]{}<>\"'#/|*_-–—"
    tokens = F.filter(F.split(F.translate(unit, signs, " " * len(signs)), " "), lambda w: w != "")
    return (
        F.when(matches(unit, ERRORS), "error")
        .when(matches(unit, SCRIPTS), "script")
        .when(matches(unit, FILLERS), "filler")
        .when(_let(tokens, filler), "filler")
        .when(matches(unit, FOLLOW_UPS), "follow")
    )


def messages(docs: DataFrame) -> DataFrame:
    """(hash, size, unit, n_docs, wide) of every different masked unit. ``docs``: (source, units), units being
    array<struct<hash, size, unit>>, of all documents. A document counts once, however often it has
    the unit."""
    each = docs.select(F.xxhash64("source").alias("source"), F.explode(F.array_distinct("units")).alias("x"))
    counted = each.select("source", "x.hash", "x.size", "x.unit").groupBy("hash", "size", "unit").agg(
        F.count("*").alias("n_docs"), F.min("source").alias("low"), F.max("source").alias("high")
    )
    return counted.select("hash", "size", "unit", "n_docs", ((F.col("n_docs") >= WIDE_DOCS) & (F.col("low") < F.col("high"))).alias("wide"))


def message_classes(found: DataFrame) -> DataFrame:
    """(hash, size, kind, n_docs) of the messages that say something: residue, a follow-up, furniture."""
    bar = F.col("unit").rlike(r"^(?:©|\(c\)) |^[^|.]{1,30}( \| [^|.]{1,30}){2,}$|^skip to (?:main )?content$")
    furniture = bar | (F.col("wide") & (F.length("unit") <= FURNITURE_CHARS))
    classed = found.withColumn("kind", F.coalesce(unit_kind(F.col("unit")), F.when(furniture, "furniture"))).filter("kind is not null")
    return classed.select("hash", "size", F.when((F.col("kind") == "follow") & F.col("wide"), "error").otherwise(F.col("kind")).alias("kind"), "n_docs")


def residue_report(docs: DataFrame) -> DataFrame:
    """(doc_id, placeholder, kind, share, message_docs) of every document with any sign of residue: whether it
    holds a placeholder, its main kind of message, the share of its letters in messages, and the
    number of documents that have its main message."""
    texts = widen(docs.filter("text is not null").select("doc_id", "source", "text"))
    cut = texts.select("doc_id", "source", has_placeholder(F.col("text")).alias("placeholder"), F.explode(F.array(units(F.col("text")))).alias("u"))
    size = lambda u: F.length(F.regexp_replace(u["unit"], r"[^\p{L}\p{N}#]+", ""))
    title = lambda u: (u["at"] <= 3) & (F.length(u["unit"]) <= FURNITURE_CHARS) & ~u["unit"].rlike(r"[.!?;:]$")
    numbers = F.transform("u", lambda u: F.struct(F.xxhash64(u["unit"]).alias("hash"), size(u).alias("size")))
    # every text is read and cut once; what it holds is in columns, of which later jobs read what they need
    kept = written(cut.select("doc_id", "source", "placeholder", F.transform("u", lambda u: u["unit"]).alias("texts"), numbers.alias("numbers"), F.transform("u", title).alias("titles")))
    listed = kept.select("source", F.zip_with("numbers", "texts", lambda n, t: F.struct(n["hash"].alias("hash"), n["size"].alias("size"), t.alias("unit"))).alias("units"))
    classes = written(message_classes(messages(listed)))
    most = max(1, int(kept.count() * HOT_SHARE))
    as_one = lambda some, name: some.select("hash", "size", F.struct("kind", "n_docs").alias(name))
    hot = as_one(classes.filter(F.col("n_docs") > most), "hot")
    rest = as_one(classes.filter(F.col("n_docs") <= most), "rest").withColumnRenamed("hash", "key").withColumn("open", F.lit(True))
    rows = kept.select("doc_id", F.posexplode(F.arrays_zip("numbers", "titles")).alias("at", "x")).select("doc_id", "at", "x.numbers.hash", "x.numbers.size", F.col("x.titles").alias("title"))
    placed = rows.join(F.broadcast(hot), ["hash", "size"], "left").withColumn("open", F.col("hot").isNull())
    # what the hot messages have settled needs no partner any more and is spread evenly
    keyed = placed.withColumn("key", F.when(F.col("open"), F.col("hash")).otherwise(F.xxhash64("doc_id", "at")))
    joined = keyed.join(rest, ["key", "size", "open"], "left").select("doc_id", F.col("size").cast("long").alias("n"), "title", F.coalesce("hot", "rest").alias("c"))
    residue = F.coalesce(F.col("c.kind").isin("error", "script", "filler"), F.lit(False))
    sums = joined.groupBy("doc_id").agg(
        F.sum(F.when(residue, F.col("n")).otherwise(0)).alias("residue"),
        F.sum(F.when(F.col("c").isNull() & ~F.col("title"), F.col("n")).otherwise(0)).alias("sound"),
        F.max(F.when(residue, F.struct("n", "c"))).alias("main"),
    )
    share = F.col("residue") / (F.col("residue") + F.col("sound"))
    shares = sums.filter("residue > 0").select("doc_id", F.col("main.c.kind").alias("kind"), share.alias("share"), F.col("main.c.n_docs").alias("message_docs"))
    holders = kept.filter("placeholder").select("doc_id", "placeholder")
    both = holders.join(shares, "doc_id", "full")
    return both.select("doc_id", F.coalesce("placeholder", F.lit(False)).alias("placeholder"), "kind", F.coalesce("share", F.lit(0.0)).alias("share"), "message_docs")


def residue_docs(docs: DataFrame, main_share: float = MAIN_SHARE) -> DataFrame:
    """(doc_id) of the documents to exclude."""
    return residue_report(docs).filter(F.col("placeholder") | (F.col("share") >= main_share)).select("doc_id")
