"""Template residue, filler and error notices among instruction texts.

Evidence comes from three sides. Detectors look for unfilled placeholders, filler, error pages and
script notices in the text itself. The body's terms are compared with all other texts: for each word it is learned
how often it stands in texts that open like an instruction (a verb, then its object). Text whose words
the instructions don't use is residue, though no detector knows it; a text that opens like an
instruction is content even where it mentions such words. And the hosts: terms that a text shares with its
address slug (task_slug) speak for content.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.operators.skewjoin import lookup_by_key
from stepforge.session import durable

#: Fields whose values are instruction texts.
_FIELD = re.compile(r"caption|captions|seen|language_instruction(_\d+)?").fullmatch


def instruction_texts(record: object) -> Iterator[str]:
    """The instruction texts of a parsed record: text fields, and elements of a list of strings."""
    if isinstance(record, list):
        for element in record:
            if isinstance(element, str):
                yield element
            elif isinstance(element, dict):
                yield from instruction_texts(element)
    elif isinstance(record, dict):
        for name, value in record.items():
            if _FIELD(name):
                if isinstance(value, str):
                    yield value
                elif isinstance(value, list):
                    yield from instruction_texts(value) if any(isinstance(v, dict) for v in value) else (
                        v for v in value if isinstance(v, str)
                    )


# ---------------------------------------------------------------- normal forms

_WRAP = " \t\r\n  '\"“”‘’«»().,;:!?…*>|-–—#=~`"
_LEAD = re.compile(r"^(?:(?:task|instruction|caption|text|label|title|prompt|en|de|es|fr)\s*[:\-–]\s+|\d+\s*[).]\s+|>+\s*|[-*•]\s+)+", re.I)
_TAIL = re.compile(r"\s*\((?:take|ref|code|no\.?|#)?\s*\d+\)\s*$", re.I)
_TAGS = re.compile(r"</?(?:setup|control)_(?:start|end)>|\[\s*(?:left|right|both|lefts?|rights?)\w*\s+arms?\s*\]|\[\s*(?:left|right|both)\s*\]", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*", re.UNICODE)


def core_text(text: str) -> str:
    """The text without take numbers, list marks, field labels and quotes around it, spaces collapsed."""
    text = " ".join(text.split())
    for _ in range(3):
        before = text
        text = _TAIL.sub("", text)
        text = _LEAD.sub("", text.strip(" '\"“”‘’«»"))
        if text.startswith("(") and text.endswith(")"):
            text = text[1:-1]
        if text == before:
            break
    return text.strip()


def words(text: str) -> list[str]:
    """Lower-case words; numbers become 0."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower().replace("’", "'"))]


# ---------------------------------------------------------------- detectors

# Forms of template placeholders.
PLACEHOLDERS = (
    r"\{\{[^{}]*\}\}",
    r"\{%[^{}%]*%\}",
    r"[$#]\{[^{}]*\}",
    r"\{\s*\d*\s*\}",
    r"\{\s*[A-Za-z_][\w.\-]*\s*(?:![rsa])?(?::[^{}\s,]*)?\s*\}",
    r"%\(\w+\)[a-z]",
    r"(?:^|\s)%[sdrfi](?=\s|$|[.,;:!?])",
    r"\$[A-Za-z_]\w*\$",
    r"(?:^|[\s(\"'“])\$[A-Z_]{2,}\b",
    r"(?<![\w])__+[A-Za-z]\w*?__+(?![\w])",
    r"(?<!\w)_{3,}(?!\w)",
    r"(?<!\w)#[A-Za-z_]+#(?!\w)",
    r"<\s*(?!/?(?:setup|control)_(?:start|end)\b)[A-Za-z_][\w \-]{0,40}>",
    r"&lt;\s*[A-Za-z_][\w \-]{0,40}&gt;?",
    r"\[\s*(?:\.{2,}|…)\s*\]",
    r"\[\s*(?:insert|enter|add|your|type|put|choose|select|fill)\b[^\[\]]*\]",
    r"\[\s*[A-Za-z]+(?:_[A-Za-z]+)*\s*\]",
    r"\[\[[^\[\]]*\]\]",
    r"(?<!\w)[xX]{3,}(?!\w)",
    r"(?:\b(?:insert|enter|type|add|put) (?:your )?\w+(?:[ _]\w+)? here\s*[.!\]]*\s*$)",
)

# Whole texts that say that there is no text, in normal form.
EMPTY_TEXTS = (
    "nan none null nil undefined empty blank void unknown untitled missing todo tbd tba fixme wip n/a na n.a nothing placeholder filler "
    "dummy qwerty asdf asdfgh test testing temp tmp foo bar foobar xxx string text caption instruction description sample example default"
).split()

# Filler and notes that there is no text or picture.
FILLER = (
    r"^(?:no|without|missing|empty|blank) (?:\w+ )?(?:text|caption|instruction|description|annotation|label|image|picture|video|audio|data|title|content)s?\b(?: (?:provided|available|given|found|yet|here|set|for .*))?$",
    r"^(?:text|caption|instruction|description|annotation|image|picture|video|label)s? (?:is |are )?(?:not |un)(?:yet )?(?:provided|available|given|found|set)\b",
    r"\b(?:caption|text|instruction|description|title|label|content) goes here\b",
    r"\byour (?:own )?(?:text|caption|instruction|description|title|content) here\b",
    r"^(?:enter|type|add|insert|write|provide) (?:your|an|the|a) (?:instruction|caption|text|description|title|label)s?\b(?: here| below)?$",
    r"\b(?:write|add|fill in|provide|insert) (?:the |an? )?(?:instruction|caption|text|description)s?\b.*\b(?:later|soon|pending|afterwards)$",
    r"^describe what\b|^describe the (?:clip|video|scene|image|picture|action)\b",
    r"\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipi",
    r"^(?:todo|tbd|tba|fixme|xxx)\b",
    r"^placeholder (?:text|caption|instruction|value|content)\b",
    r"^(?:dummy|sample|example|test|temp|default) (?:text|caption|instruction|sentence|string|description|entry|record)s?(?: 0)?(?: (?:dummy|sample|example|test) (?:text|caption|instruction)s?)*(?: 0)?$",
    r"^test(?: test)+(?: 0)*$|^test 0$|^(?:asdf?g?h?|qwert[yz]|asd|foo|bar|blah?)(?: (?:asdf?g?h?|qwert[yz]|asd|foo|bar|blah?))*$",
    r"\bnothing to (?:describe|see|show|annotate|caption|report)\b",
    r"\b(?:has|have|with|contains?) no (?:picture|image|video|frames?|text|caption|audio|content|data)s?\b",
    r"\b(?:camera|clip|video|image|recording|picture|screen|feed|frame)s?(?: \w+)? (?:is|are|was|were) (?:\w+ )?(?:black|blank|empty|dark|missing|corrupt(?:ed)?|broken|unavailable|unreadable)\b",
    r"\b(?:clip|video|recording|image|picture|file|page|feed|stream|site)s? (?:does not|doesn't|did not|didn't|cannot|can't|could not|couldn't|will not|won't|can not|failed to) (?:be )?(?:load|open|play|start|found|displayed?|shown?|reach)",
    r"\b(?:is|are) no longer available\b|\b(?:not|un)available (?:right now|at the moment|at this time)\b",
    r"\bto be (?:done|determined|added|filled(?: in)?|written|defined|announced)(?: later)?$",
    r"^(?:kein|ohne) (?:text|bild|titel|beschreibung)\b|^(?:sin|ningún) (?:texto|título|descripción|imagen)\b|^(?:pas de|aucun|sans) (?:texte|titre|description|image)\b",
)

# Error pages and program errors.
ERRORS = (
    r"\b(?:404|403|401|400|405|408|410|429|500|501|502|503|504)\b.{0,12}\b(?:error|not found|forbidden|unauthori[sz]ed|bad|too many|internal|gateway|service|unavailable|time-?out|request|denied|gone)",
    r"\b(?:error|fehler|erreur|code|http|status)s?\b.{0,4}\b(?:404|403|401|400|408|410|429|500|501|502|503|504)\b",
    r"^(?:page |file |resource |url )?not found$",
    r"\b(?:page|file|url|resource|site)\b.{0,30}\b(?:could not be|cannot be|can't be|was not|wasn't|not) (?:found|reached|loaded|displayed)\b",
    r"\binternal server error\b|\bbad gateway\b|\bgateway time-?out\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\bserver error\b",
    r"\btoo many requests\b|\brate limit exceeded\b|\brequest time(?:d )?-?out\b|\brequest timeout\b|\bbad request\b|\bupstream\b.{0,30}\b(?:error|timeout|failed)\b",
    r"^(?:access|permission) denied\b|\byou (?:do not|don't) have (?:permission|access)\b|^(?:error|warning|exception|fatal|failed)\s*[:#\-]",
    r"\bsomething went wrong\b|\bunexpected error\b|\ban error (?:has )?occurred\b|\b(?:please )?try again later\b|^oops\b",
    r"\bsession (?:has |is )?(?:expired|timed out)\b|\bsign in (?:again|to continue)\b|\blog ?in to (?:continue|view)\b",
    r"\btraceback \(|\bmost recent call last\b|\b[a-z.]*(?:key|value|type|index|attribute|runtime|name|import|syntax|assertion|memory|io|os|unicode\w*|zerodivision|notimplemented|modulenotfound|filenotfound|connection|timeout)error\b\s*[:(]|\b\w*exception\b(?:\s*[:(]| at | in )|\bnullpointerexception\b|\bstack ?trace\b|\bsegmentation fault\b|\bcore dumped\b|\bout of memory\b",
    r"\[object object\]|\bundefined is not\b|\bcannot read propert",
    r"\bdid not (?:answer|respond) in time\b|\btimed out\b|\bconnection (?:was )?(?:refused|reset|closed|lost|timed out)\b",
    r"<\s*/?\s*(?:html|head|body|title|div|script|span|h\d|p|br)\b|<!doctype\b",
    r"\bthis (?:site|page|clip|video|resource|content) (?:can't|cannot|could not|is not|isn't|is no longer)\b",
    r"\bseite (?:wurde )?nicht gefunden\b|\bserverfehler\b|\bein fehler ist aufgetreten\b|\bzugriff verweigert\b|\b(?:dienst|seite|server) (?:ist )?(?:derzeit )?nicht (?:verfügbar|erreichbar)\b",
    r"\bpágina no encontrada\b|\bno se (?:ha )?(?:encontró|encontrado|encuentra) la página\b|\berror interno\b|\berror del servidor\b|\bacceso denegado\b|\binténtelo (?:de nuevo )?más tarde\b|\bservicio no disponible\b",
    r"\bpage introuvable\b|\berreur (?:interne|serveur|du serveur)\b|\bune erreur (?:est survenue|s'est produite)\b|\baccès refusé\b|\bservice indisponible\b|\bréessayez plus tard\b",
)

# Requests for scripts, cookies or a human check.
NOTICES = (
    r"\b(?:enable|activate|allow|turn on|switch on|unblock|accept|require[sd]?|requires|needs?)\b(?:\W+\w+){0,4}\W+(?:java ?script|scripts?|scripting|cookies)\b",
    r"\b(?:java ?script|scripts?|scripting|cookies)\b(?:\W+\w+){0,3}\W+(?:disabled|blocked|required|enabled|off|needed|deactivated)\b",
    r"\b(?:does not|doesn't|cannot|can't|won't|not)\b(?:\W+\w+){0,2}\W+(?:run|support|work|execute|load)\b(?:\W+\w+){0,2}\W*\b(?:java ?script|scripts?|cookies)\b",
    r"\bnoscript\b",
    r"\b(?:aktivieren|erlauben|zulassen|einschalten)\b.{0,30}\b(?:java ?script|skripte?|cookies)\b|\b(?:java ?script|skripte?|cookies)\b.{0,30}\b(?:aktivieren|erlauben|einschalten|deaktiviert)\b",
    r"\b(?:habilite|habilitar|active|activar|active|permita|acepte)\b.{0,30}\b(?:java ?script|scripts?|cookies)\b|\b(?:java ?script|cookies)\b.{0,30}\b(?:desactivado|deshabilitado|desactivadas)\b",
    r"\b(?:activer|activez|autoriser|autorisez|accepter|acceptez)\b.{0,30}\b(?:java ?script|scripts?|cookies)\b|\b(?:java ?script|cookies)\b.{0,30}\b(?:désactivé|désactivés|bloqué)\b",
    r"\b(?:verify|confirm|prove|check)\b.{0,20}\b(?:human|robot|not a bot)\b(?: to (?:continue|proceed))?$|\byou are (?:a )?human\b|\bnot a robot\b|\bcaptcha\b|\bare you (?:a )?human\b",
    r"\bchecking your browser\b|\bjust a moment\b|\bdein(?:en)? browser\b|\b(?:su|tu) navegador\b|\bvotre navigateur\b|\b(?:in|update|of|by) your (?:web )?browser\b|\breload (?:the|this) page\b|\ballow (?:them|it) and reload\b",
)

# Words that residue often has and content seldom; they count only with other evidence.
CUES = frozenset(
    "error errors page browser javascript script scripts cookies server request reload unavailable timeout denied forbidden caption "
    "instruction placeholder dummy sample filler lorem ipsum todo tbd null none nan undefined empty missing annotation clip video "
    "session login human captcha loading failed fehler erreur seite navegador navigateur exception gateway http https sorry oops "
    "please bitte veuillez download refresh expired blocked disabled enable text".split()
)

_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS), re.I)
#: What every placeholder has; most texts have none of it.
_SIGNS = re.compile(r"[{}\[\]<>$%#&]|__|xxx|\shere\s*[.!\]]*\s*$|^(?:insert|enter|type|add|put)\b.*\bhere\b", re.I)
_STRONG = re.compile("|".join(f"(?:{p})" for p in (*FILLER, *ERRORS, *NOTICES)), re.I)
_EMPTY = frozenset(EMPTY_TEXTS)
#: Words that follow an instruction's verb; after any other word an unknown first word is no verb.
_OBJECT = frozenset("the a an both all each every this that these those up down over out in one two three four it them its any none some".split())
#: First words that are articles, questions and the like, not verbs.
_NO_VERB = frozenset(
    "the a an this that these those your my our we you it there no not an error page please sorry in on at to for of is are was if "
    "what which who why how when where and or but access http todo task caption".split()
)

STRONG, WEAK, NONE = 2, 1, 0


def inspect(text: str) -> tuple[int, str, bool]:
    """How suspect a text is by itself (STRONG, WEAK, NONE), its normal form, and whether it opens like an instruction."""
    flat = " ".join(text.split())
    bare = _TAGS.sub(" ", flat)
    core = core_text(bare)
    tokens = words(core)
    form = " ".join(tokens)
    if not flat:
        return NONE, "", False
    if _SIGNS.search(bare) and _PLACEHOLDER.search(bare):
        return STRONG, form, False
    opens = len(tokens) >= 3 and tokens[0] not in _NO_VERB and tokens[1] in _OBJECT
    low = core.lower().replace("’", "'").strip(_WRAP)
    joined = form.replace(" ", "")
    if low.strip("<>[](){}") in _EMPTY or joined in _EMPTY or low in ("n/a", "n. a", "n.a"):
        return STRONG, form, False
    if not opens and (_STRONG.search(low) or _STRONG.search(form)):
        return STRONG, form, False
    if opens and _NOTE_LATER.search(low):
        return STRONG, form, False
    if opens and (_HARD.search(low)):
        return STRONG, form, False
    weak = not tokens or bool(CUES & set(tokens))
    return (WEAK if weak else NONE), form, opens


#: Even in a sentence that opens like an instruction these are never about a robot's task.
_HARD = re.compile(
    r"\blorem ipsum\b|\bmost recent call last\b|\b(?:enable|activate|turn on) (?:java ?script|cookies|scripts)\b|\byou are (?:a )?human\b"
    r"|\bto (?:run|view|use) this (?:app|page|site|caption|clip)\b|\bcaption goes here\b|\bnothing to describe\b"
)
_NOTE_LATER = re.compile(r"\b(?:write|add|fill in|provide|insert) (?:the |an? )?(?:instruction|caption|text|description)s?\b.*\b(?:later|soon|pending|afterwards)$")


# ---------------------------------------------------------------- evidence of hosts


@dataclass(frozen=True)
class ResidueRules:
    """When a text that doesn't open like an instruction is residue by the evidence of its words and hosts.

    All are shares, so they mean the same for any number of records.
    """

    #: Part of the corpus's own share of instructions below which the mean share of a text's words must be ...
    words: float = 0.75
    #: ... and the same for a text that shares a term with the slug in most of its rows.
    shared: float = 0.5
    #: Least share of texts that open like an instruction; with fewer nothing is learned.
    base: float = 0.25


_ROWS = "instr_id bigint, dataset string, task_slug string, form string, mark int, opens boolean, shared boolean, word string, n bigint, n_open bigint"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that a detector is sure of or that don't open like an instruction, and at the end the words of all texts with their counts."""
    names = _ROWS.replace(",", "").split()[::2]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
    every: Counter[str] = Counter()
    opened: Counter[str] = Counter()

    def block(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        rows: list[tuple] = []
        for i, dataset, slug, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if raw is None:
                continue
            try:
                texts = list(instruction_texts(json.loads(raw, parse_constant=_refuse)))
            except (ValueError, RecursionError):
                continue
            for text in texts:
                if not text.strip():
                    continue
                mark, form, opens = inspect(text)
                found = set(form.split())
                every.update(found)
                every[""] += 1  # the texts themselves
                if opens and mark < STRONG:
                    opened.update(found)
                    opened[""] += 1
                else:
                    shared = not found.isdisjoint((slug or "").split("_"))
                    rows.append((i, dataset, slug, form, mark, opens, shared, None, None, None))
        yield block(rows)
        if len(every) > _WORDS:
            yield block([(*[None] * 7, w, n, opened[w]) for w, n in every.items()])
            every.clear()
            opened.clear()
    yield block([(*[None] * 7, w, n, opened[w]) for w, n in every.items()])


#: Distinct words that a task counts before it passes them on.
_WORDS = 500_000


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _marked(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that a detector is sure of or that don't open like an instruction, most are neither; and the word counts. Parsed once and kept."""
    rows = durable(records.select("instr_id", "dataset", "task_slug", "instructions").mapInArrow(_texts, _ROWS))
    counts = rows.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open"))
    return rows.where("word IS NULL").drop("word", "n", "n_open"), counts


def judged_texts(records: DataFrame, rules: ResidueRules = ResidueRules()) -> DataFrame:
    """Distinct forms that don't open like an instruction with their evidence: (form, n_rows, n_slugs, n_hosts, mark, shared, share, residue).

    ``records`` needs instr_id, dataset, task_slug, instructions. ``mark`` is the detectors' word, which ``residue`` doesn't use.
    """
    return _judged(*_marked(records), rules)


def _judged(marked: DataFrame, counts: DataFrame, rules: ResidueRules) -> DataFrame:
    whole = counts.where("word = ''").first()
    base = whole.n_open / whole.n if whole and whole.n else 0.0
    # Copies under one slug are counted first, so that a text with a third of all rows is small at once.
    by_slug = marked.where("form <> ''").groupBy("form", "task_slug", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.max("mark").alias("mark"), F.sum(F.col("shared").cast("bigint")).alias("n_shared")
    )
    forms = durable(
        by_slug.groupBy("form").agg(
            F.sum("n").alias("n_rows"),
            F.count_distinct("task_slug").alias("n_slugs"),
            F.count_distinct("dataset").alias("n_hosts"),
            F.max("mark").alias("mark"),
            (F.sum("n_shared") * 2 > F.sum("n")).alias("shared"),
        )
    )
    words = forms.select("form", "n_rows", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    found = lookup_by_key(words, counts.where("word <> ''"), "word", "n", "form", words.count())
    # A text's own rows say nothing about it; a word that no other text has counts as half of the corpus's share.
    others = F.col("n") - F.col("n_rows")
    share = (F.col("n_open") + F.lit(base / 2)) / (F.greatest(others, F.col("n_open")) + 1)
    scores = found.groupBy("form").agg(F.avg(share).alias("share"))
    limit = F.when(F.col("shared"), F.lit(rules.shared)).otherwise(F.lit(rules.words)) * F.lit(base)
    known = F.lit(base >= rules.base)
    return forms.join(scores, "form").withColumn("residue", known & (F.col("share") < limit))


def residue_records(records: DataFrame, rules: ResidueRules = ResidueRules()) -> DataFrame:
    """(instr_id): records with at least one instruction text that is residue.

    ``records`` needs instr_id, dataset, task_slug and instructions (JSON). Copies each count. Null,
    invalid and blank texts and records without an instruction text don't; null slugs and
    datasets give no evidence. No rows give no rows.
    """
    marked, counts = _marked(records)
    by_form = _judged(marked, counts, rules).where("residue").select("form", "n_rows").withColumn("residue", F.lit(True))
    found = lookup_by_key(marked.select("instr_id", "form", "mark"), by_form, "form", "n_rows", "instr_id", marked.count())
    return found.where((F.col("mark") == STRONG) | F.coalesce("residue", F.lit(False))).select("instr_id").distinct()


def without_residue(records: DataFrame, rules: ResidueRules = ResidueRules()) -> DataFrame:
    """The records that residue_records does not name, with all their columns."""
    return records.join(residue_records(records, rules), "instr_id", "left_anti")
