"""Problem 8: records that hold template residue, filler, error pages or demands for scripts instead of content.

Messages are mined with a fixed-depth prefix tree, as log lines are. A document's bare lines (lines of prose that are no
comment, string or code, with markup and JSON wrapping taken off and numbers masked) go down by number of tokens and
first two tokens to a leaf, where lines with the same skeleton are one template: a skeleton has wildcards for the words
that the lexicons below do not speak of. The levels of the tree are columns, so that it is mined by one aggregate with
map-side combining: a page that a third of all records consist of is one row from each task, no leaf is held anywhere,
and a template is the same whatever else the corpus has. A template knows in how many documents it occurs and how many
of these are source files that consist of it alone. Each template is classified once: by the lexicons, or as a message in place of
content if most of its documents have nothing else. Its verdict goes back to all documents with a line of it.

Placeholders are found separately, inside ordinary lines: a slot is a mark around the name of a usual value (title, author,
...), or around any name where the value of a field or a word of a sentence should stand.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.session import Scratch

# Names of values that templates leave to be filled in.
SLOT_NOUNS = "title name holder owner purpose description tagline author maintainer company organisation organization summary slug email".split()
SLOT_WORDS = "your insert enter add project app application module package repo repository short full long of the here goes copyright user".split()
SLOT_YEARS = "year yyyy".split()

# Endings of files that are templates themselves.
TEMPLATE_ENDINGS = "in j2 jinja jinja2 tmpl tpl template mustache hbs handlebars erb ejs tt liquid njk cookiecutter".split()
# Endings and languages in which dollar marks are working syntax, outside comments.
DOLLAR_SYNTAX = "sh bash zsh js mjs cjs ts tsx jsx py rs go java c h php pl mk sql css yml yaml".split()

# What servers say instead of a file.
STATUS = (
    "not found|forbidden|too many requests|service (?:temporarily )?unavailable|internal (?:server )?error|server error|gone|bad gateway|gateway time-?out|"
    "request time-?out|unauthori[sz]ed|access (?:denied|refused)|login required|payment required|method not allowed|bad request|page not found|whoops|oops|not acceptable|conflict|"
    "moved permanently|temporarily unavailable"
)
THING = "page|file|document|resource|object|blob|item|address|url|path|revision|commit|link|site|mirror|server|service|store|repository|content"
# What a sentence goes on with that explains an error instead of being one.
EXPLAINED = r"(?!.*\b(?:when|whenever|means|if|unless|until)\b)"
ERRORS = [
    rf"(?:http/?\S* )?(?:err(?:or)?:? )?(?:<\*>:? )?\(?(?:{STATUS})\)?(?: <\*>)?[.!]?",
    rf"(?:http/?\S* |err(?:or)?:? |status:? |code:? )*<\*>[:,]? \(?(?:{STATUS})\b\)?(?!.*\b(?:is|are|when|means|if|for)\b)(?: ?\S+){{0,8}}",
    r"error:? <\*>[.!]?.*",
    rf"(?:error|fatal|warning): .*\b(?:{STATUS}|too long|reset|refused|missing|failed|timed? ?out|fetching|objects?|denied|cannot|could not)\b.*",
    rf"(?:[^\W\d]+[.,!:;]+ ){{0,2}}(?:the|this|that|your) (?:requested )?(?:{THING})\b.*\b(?:not found|does not exist|no longer|(?:could|can|may|cannot) ?(?:not )?be (?:found|loaded|shown|opened|viewed|served|displayed|reached)|is gone|was (?:re)?moved|been (?:re)?moved|been deleted|is not here|not here|(?:is|are|was) (?:\w+ )?(?:unavailable|not available)|being serviced|too long to (?:load|answer)|timed out)\b.*",
    rf"(?:the|this|that) (?:{THING}) you (?:asked|requested|were looking|are looking|want)\b.*",
    r"(?:we are |we're )?(?:sorry|oops|whoops|uh-?oh)\b[,!.:].*",
    rf".*\b(?:we|it) (?:could not|cannot|can't|couldn't|were unable to|was unable to) (?:find|load|open|fetch|reach|serve|display|show)\b.*",
    r".*\b(?:over the limit|rate limit|limit of requests|too many requests)\b.*",
    r".*\byou have to (?:sign|log) in\b.*|.*\b(?:sign|log) in (?:first|to continue)\b.*|.*\bcontact the people who run\b.*",
    rf".*\bthis (?:{THING}) is not here\b.*|.*\bsomething (?:broke|went wrong)\b.*",
    rf"(?:sorry[,.] )?(?:an?|some|the) (?:[^\W\d]+ ){{0,3}}(?:error|exception|failure|fault|problem) (?:has |have |had )?(?:occurred|happened|arisen|(?:was|been) (?:thrown|raised|encountered))\b{EXPLAINED}.*",
    rf"(?:access|permission|entry)\b.*\b(?:denied|restricted|refused|forbidden|blocked|revoked|prohibited|(?:not|n't) (?:been )?(?:allowed|permitted|granted))\b{EXPLAINED}.*",
    rf"(?:sorry[,.] )?you (?:do not|don't|are not|aren't) (?:currently )?(?:have|allowed|authori[sz]ed|permitted)\b.*\b(?:access|permission|rights?|view|see|open)\b{EXPLAINED}.*",
    rf"(?:sorry[,.] )?your (?:request|connection|session|address|ip)\b.*\b(?:blocked|expired|rejected|refused|denied|timed? ?out|(?:could|can) ?not be (?:processed|completed|handled|served|verified))\b{EXPLAINED}.*",
    r".*\bobjects? missing\b|fatal: .*|.*\bconnection (?:reset|refused|closed)\b.*",
    r".*\b(?:no se encontró|página no encontrada|no se pudo encontrar|no existe)\b.*|.*\b(?:page introuvable|fichier (?:demandé|introuvable)|n'existe pas|erreur interne)\b.*",
    r".*\b(?:seite|datei) .*(?:nicht gefunden|existiert nicht|nicht vorhanden)\b.*|.*(?:не найден|не существует|недоступ|見つかりません|存在しません|未找到|找不到|不存在|찾을 수 없).*|seite nicht gefunden.*|.*\b(?:pagina non trovata|página não encontrada|pagina niet gevonden)\b.*",
]
SCRIPTS = r"(?:java ?script|scripts?|scripting)"
NOTICES = [
    rf".*\b(?:enable|turn on|switch on|allow|activate|needs?|requires?|without)\b.*\b{SCRIPTS}\b.*",
    rf".*\b{SCRIPTS}\b.*\b(?:enabled?|turned on|switched on|required|needed|disabled|turned off|blocked|allowed)\b.*",
    r".*\b(?:does not|do not|doesn't|cannot|can't) (?:run|support|execute) (?:java ?script|scripts?)\b.*",
    r".*\b(?:activez|activer|activé|active|habilite|habilitar|einschalten|aktivieren|aktiviert|abilita|attiva|ative|inschakelen)\b.*\bjavascript\b.*|.*\bjavascript\b.*\b(?:activez|activer|activé|active|habilite|einschalten|aktivieren|aktiviert|abilita|attiva|ative|inschakelen|activado|necesario|nécessaire|erforderlich)\b.*",
    rf".*\b(?:must|has to|have to|should) (?:support|run|allow|accept)\b.*\b{SCRIPTS}\b.*|.*javascript.*(?:включ|有効|启用|啟用|활성).*|.*(?:включ|有効|启用|啟用|활성).*javascript.*",
    r"(?:please )?(?:wait|hold on|stand by|one moment|just a moment|hang on)\b.*\b(?:verif|check|confirm|validat|test|prov)\w*\b.*\b(?:browser|human|robot|bot|visitor|connection|request)\b.*",
    r"(?:please )?(?:we are |we're |we need to )?(?:verif|check|confirm|validat|test|prov)\w*\b.*\b(?:your browser|you are (?:a )?(?:real )?(?:human|person)|(?:not|aren't) a (?:ro)?bot|your connection is secure)\b.*",
    r"(?:please )?(?:complete|solve|pass|finish) (?:the|this) (?:\w+ )?(?:check|challenge|puzzle|test)\b.*\b(?:continue|proceed|go on|see|view|open)\b.*",
    r".*\byou are (?:a )?(?:human|not a robot)\b.*|.*\b(?:captcha|browser is being (?:looked at|checked)|checking your browser)\b.*",
]
# What is said beside content that is there: the notice is no demand.
BESIDE = re.compile(r"\bwithout (?:it|them)\b|\bsome \w+ needs?\b|\bstill works?\b")

# Words of the usual filler text.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat "
    "non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
KEYS = "asdf qwer qwerty zxcv hjkl foo bar baz blah bla xxx".split()
FILLERS = [
    r"(?:this|that) is (?:a|an|only a|just a) (?:placeholder|dummy|sample)\b.*|.*\bcontent (?:will|to) (?:follow|come|be added)\b.*|(?:coming soon|to be written|under construction|tbd|tba)[.!]*",
    r"(?:replace|delete|remove|edit|overwrite) (?:this|these|the) (?:\w+ )?(?:text|line|lines|paragraph|paragraphs|file|page|section|sentence|content)\b.*",
    r"(?:describe|write|explain|summari[sz]e|list|document|add|put|insert|enter) (?:your|its|the|a|an) .*\bhere\b.*",
    r"(?:your|text|title|content|description|summary|name|some text|body)(?: \w+)? (?:goes|starts|belongs|comes) here\b.*",
    r"(?:your|insert) (?:\w+ ){0,3}(?:here|text)[. ]*",
]

ERROR = re.compile("|".join(f"(?:{p})" for p in ERRORS))
NOTICE = re.compile("|".join(f"(?:{p})" for p in NOTICES))
FILLER = re.compile("|".join(f"(?:{p})" for p in FILLERS))

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TAG = re.compile(r"<[^<>]*>")
NOSCRIPT = re.compile(r"(?is)<noscript\b[^<>]*>(.*?)</noscript\s*>")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
# Keys of what error bodies say, and how many values such a body has at most; tables of texts have more.
JSON_KEYS = "message error errors detail details msg reason error_description error_message errormessage".split()
JSON_VALUES = 20
JSON_SAYS = re.compile(rf'(?i)"(?:{"|".join(JSON_KEYS)})"\s*:')
JSON_MESSAGE = re.compile(r'\{\s*"(?:message|error|detail|msg|reason)"\s*:\s*"([^"]*)"')
MASK = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+(?:\.\d+)*")
CODE = re.compile(r"[;={}\\`|]|\w\(|->|::|=>|\w\.\w+\(|^\s*(?:#|//|--|/\*|\*|[-+>] |\"|'|\w+: *$|\w+[_\w]*:\s)")
STARTS = re.compile(r"[\w¡¿<{(]", re.UNICODE)
PROSE = re.compile(r"^(?:(?:err|error|fatal|warning|request|https?/?\S*)\b|<\*>).*", re.I)


def markup_pieces(line: str) -> list[tuple[str, bool]]:
    """The pieces of text of a line of markup, each with whether a noscript element holds it beside more than eight others."""
    line = re.sub(r"(?is)<style.*?</style>|<script.*?</script>", "\n", line)
    texts = lambda x: [p for p in (y.strip() for y in TAG.sub("\n", x).split("\n")) if p]
    parts = NOSCRIPT.split(line)  # text outside and inside by turns
    content = sum(len(texts(x)) for x in parts[::2]) > 8
    return [(p, content and k % 2 == 1) for k, x in enumerate(parts) for p in texts(x)]


def _fences(lines: list[str]) -> set[int]:
    """Numbers of the lines that open or close quoted code; a last fence that nothing closes is none."""
    at = [i for i, line in enumerate(lines) if line.startswith(("```", "~~~"))]
    return set(at[: len(at) // 2 * 2])


def bare_lines(text: str) -> list[tuple[str, bool]]:
    """The lines of a text that could be messages, masked, each with whether it stands in a noscript element only."""
    lines = [line.strip("\ufeff \t") for line in re.split(r"\r\n|\r|\n", text)]
    said = json_messages(text) if len(lines) > 1 else []
    fences = _fences(lines)
    out, fenced = [(x, False) for x in map(masked_piece, said) if x], False
    for i, line in enumerate(lines):
        if i in fences:
            fenced = not fenced
            continue
        if not line or fenced or not STARTS.match(line):
            continue
        aside = False
        if line[0] == "{":
            found = JSON_MESSAGE.match(line)
            pieces = [(m, False) for m in dict.fromkeys([*json_messages(line), *([found.group(1)] if found and line.endswith("}") else [])])]
        elif line[0] == "<":
            head = line[:12].lower()
            aside = head.startswith("<noscript")
            pieces = markup_pieces(line)
        else:
            masked = MASK.sub("<*>", line)
            if CODE.search(line) and not PROSE.match(masked):
                continue
            pieces = [(line, False)]
        for piece, beside in pieces:
            if piece := masked_piece(piece):
                out.append((piece, aside or beside))
    return out


def masked_piece(piece: str) -> str | None:
    piece = " ".join(MASK.sub("<*>", piece.lower()).split())
    return piece if WORD.search(piece) and len(piece) > 3 else None


def json_messages(text: str) -> list[str]:
    """What a text says that is one small JSON object: the values of JSON_KEYS, wherever they stand."""
    text = text.strip("﻿ \t\r\n")
    if not (text.startswith("{") and text.endswith("}") and JSON_SAYS.search(text)):
        return []
    try:
        rest = [(False, json.loads(text))]
    except (ValueError, RecursionError):
        return []
    out, values = [], 0
    while rest:
        says, x = rest.pop()
        if isinstance(x, dict):
            rest += [(k.lower() in JSON_KEYS, v) for k, v in x.items()]
            status = next((v for v in x.values() if str(v).isdigit() and 400 <= int(v) < 600), None)
            out += [f"{status} {v}" for k, v in x.items() if status and k.lower() in JSON_KEYS and isinstance(v, str)]
        elif isinstance(x, list):
            rest += [(says, v) for v in x]
        else:
            values += 1
            out += [x] if says and isinstance(x, str) else []
    return out if values <= JSON_VALUES else []


LONGEST = 40  # words of a message; longer lines are looked at sentence by sentence
RUN = 2_000  # characters over which a long line's words are counted


def _parts(line: str) -> Iterator[str]:
    """The sentences of a long line, those of more than LONGEST words as windows of so many that overlap by half."""
    for sentence in SENTENCE.split(line):
        tokens = sentence.split()
        for at in range(0, max(1, len(tokens) - LONGEST // 2), LONGEST // 2):
            yield " ".join(tokens[at : at + LONGEST])


def _runs(line: str) -> Iterator[str]:
    """All of a line in runs of whole words of about RUN characters."""
    run, size = [], 0
    for token in line.split():
        if run and size + len(token) > RUN:
            yield " ".join(run)
            run, size = [], 0
        run.append(token)
        size += len(token) + 1
    yield " ".join(run)


def verdict(template: str, repeated: bool | None = None) -> str | None:
    """What a template says in place of content; wildcards stand for words that differ.

    repeated: what ``repeats`` says of its lines, if words of them are hidden.
    """
    parts = [template]
    if sum(w != "<*>" for w in template.split()) > LONGEST:
        parts = list(_parts(template))
    found = next(filter(None, map(_phrase, parts)), None)
    if found:
        return found
    again = repeats(template) if repeated is None else repeated
    return "filler" if again or any(map(_filler_words, parts if len(parts) == 1 else (*parts, *_runs(template)))) else None


def repeats(line: str) -> bool:
    """Whether a line, or a part of a long one, says few words again and again."""
    whole = sum(w != "<*>" for w in line.split()) <= LONGEST
    return any(map(_same_words, [line] if whole else (*_parts(line), *_runs(line))))


def _phrase(template: str) -> str | None:
    if template in ("gone", "oops", "conflict") or not template.replace("<*>", "").strip():  # a word by itself says nothing
        return None
    if NOTICE.fullmatch(template) and not BESIDE.search(template):
        return "notice"
    if ERROR.fullmatch(template):
        return "error"
    return "filler" if FILLER.fullmatch(template) else None


def _plain(text: str) -> tuple[list[str], int]:
    """The words of a text without punctuation, and the number of its tokens, wildcards too."""
    tokens = text.split()
    return [w.strip(".,;:!?") for w in tokens if w != "<*>"], len(tokens)


def _filler_words(text: str) -> bool:
    plain, count = _plain(text)
    latin = count >= 5 and sum(w in _LATIN for w in plain) >= 0.8 * count and sum(w in _LATIN_ONLY for w in plain) >= 3
    return latin or (count >= 4 and sum(w in _KEYS for w in plain) >= 0.8 * count)


def _same_words(text: str) -> bool:
    # A wildcard is a word that differs from all others.
    plain, count = _plain(text)
    return bool(plain) and count >= 9 and len(set(plain)) + count - len(plain) <= count // 3


_LATIN, _KEYS = set(LATIN), set(KEYS)
_LATIN_ONLY = _LATIN - set("do in id non ex ad sit et ut ea".split())


def _fragments() -> tuple[re.Pattern, frozenset[str]]:
    """The letters that the lexicons speak of: those of three and more as a pattern, and all words."""
    source = " ".join([*ERRORS, *NOTICES, *FILLERS, BESIDE.pattern, *LATIN, *KEYS])
    words = set(re.findall(r"[a-z]+", re.sub(r"\\\w", " ", source)))
    long = sorted((w for w in words if len(w) > 2), key=len)
    return re.compile("|".join(long)), frozenset(words)


_SPOKEN, _SPOKEN_WORDS = _fragments()
RUN_OF_LETTERS = re.compile(r"\w+")
ANY_WORD = "ª"  # a letter of no lexicon: patterns take it for a word, as they do the words it stands for


def _free(word: str) -> bool:
    """Whether no verdict can rest on what a word is; short words and those with other letters may be parts of phrases."""
    return len(word) > 4 and word.isascii() and word not in _SPOKEN_WORDS and not _SPOKEN.search(word)


@lru_cache(200_000)
def _shape(token: str) -> str:
    """A token with wildcards for its free words."""
    return RUN_OF_LETTERS.sub(lambda m: ANY_WORD if _free(m[0]) else m[0], token)


DEPTH = 2  # tokens of the fixed-depth path below the number of tokens


def skeleton(line: str) -> str:
    """A line with wildcards for the words on which no verdict rests: its template within a leaf."""
    return " ".join(map(_shape, line.split()))


# Endings of source files, whose whole text cannot be a sentence.
SOURCE_ENDINGS = "py pyi js mjs cjs ts tsx jsx c h cc cpp hpp cs java kt go rs rb php pl swift scala sql sh bash css scss lua r m vue".split()
ALONE_WORDS = 4  # words that a sentence has at least


def stands_alone(text: str, path: str | None, lines: list[tuple[str, bool]]) -> bool:
    """Whether a source file's whole text is one or two sentences without any code."""
    ending = (path or "").rsplit("/", 1)[-1].lower().rpartition(".")
    if not ending[1] or ending[2] not in SOURCE_ENDINGS or not 0 < len(lines) <= 2:
        return False
    whole = [x for x in re.split(r"\r\n|\r|\n", text.strip("\ufeff \t\r\n")) if x.strip()]
    return len(whole) == len(lines) and all(x[0] not in "<{" and len(WORD.findall(x)) >= ALONE_WORDS for x in whole)


SCAN_DDL = "doc bigint, size int, head string, template string, again boolean, aside boolean, alone boolean"
SCAN = pa.schema([("doc", pa.int64()), ("size", pa.int32()), ("head", pa.string()), ("template", pa.string()), ("again", pa.bool_()), ("aside", pa.bool_()), ("alone", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places in the tree of each document's different bare lines; a row without a size if it has an open slot."""
    for batch in batches:
        out = []
        for doc, text, path in zip(*(c.to_pylist() for c in batch.columns)):
            lines = bare_lines(text)
            alone = stands_alone(text, path, lines)
            rows = {}
            for line, aside in lines:
                tokens = line.split()
                key = (len(tokens), " ".join(tokens[:DEPTH]), skeleton(line), repeats(line))
                rows[key] = rows.get(key, True) and aside
            out += [(doc, *key, aside, alone) for key, aside in rows.items()]
            if has_open_slot(text, path):
                out.append((doc, None, None, None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(SCAN), SCAN)], schema=SCAN)


CLASSED_DDL = "size int, head string, template string, again boolean, verdict string"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, head, template, again, docs, alone), one row for each template -> those that have a verdict."""
    for batch in batches:
        said = [verdict(t, a) or ("error" if 2 * alone >= docs else None) for t, a, docs, alone in zip(*(batch.column(c).to_pylist() for c in ("template", "again", "docs", "alone")))]
        keep = pa.array([v is not None for v in said])
        found = batch.select(["size", "head", "template", "again"]).filter(keep)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array([v for v in said if v], pa.string())], names=["size", "head", "template", "again", "verdict"])


NOUN = rf"(?:{'|'.join(SLOT_NOUNS + SLOT_YEARS)})"
ANY = rf"(?:{'|'.join(SLOT_NOUNS + SLOT_YEARS + SLOT_WORDS)})"
NAME = rf"(?:{ANY}[ _-]+){{0,5}}{ANY}"
SPACE_NAME = rf"[\s]*(?:\w+\.)?({NAME})[\s]*"
MARKS = re.compile(
    "|".join([
        rf"(?<!\$)\{{\{{+{SPACE_NAME}\}}\}}+", rf"<%[=-]?{SPACE_NAME}-?%>", rf"\{{%{SPACE_NAME}%\}}", rf"\[\[{SPACE_NAME}\]\]", rf"<<{SPACE_NAME}>>", rf"«{SPACE_NAME}»",
        rf"&lt;{SPACE_NAME}&gt;", rf"@@?({NAME})@@?", rf"%%?({NAME})%%?", rf"(?<!\w)__({NAME})__(?!\w)", rf"#\{{{SPACE_NAME}\}}",
        rf"(?<!\w)_({NAME})_(?!\w)",
    ]), re.I,
)
DOLLARS = re.compile(rf"\$\{{{SPACE_NAME}\}}|\$({NAME})\$", re.I)
BRACKETS = re.compile(rf"(?<![\[\w])\[({NAME})\](?![\[(\w:])|(?<![<\w])<({NAME})>(?![>\w])", re.I)
SHOUTED = re.compile(rf"(?<![\w$%@{{<\[])(?:(?:YOUR|INSERT|ENTER)[ _-]{NAME.upper()}|{NAME.upper()}[ _](?:GOES_|GOES )?HERE)(?![\w}}])|\b(?:your|insert)[ _-]{NAME}[ _-]here\b|\b(?i:title|text) goes here\b")
YOUR_NAME = re.compile(r"^\W*copyright\b.*\byour name\b", re.I)
# Marks around any name, as the whole value of a field, or as a word of a sentence.
FREE_NAME = r"[A-Za-z]\w*(?:[ _.-][A-Za-z]\w*){0,4}"
FREE_MARK = "|".join(rf"{a}\s*{FREE_NAME}\s*{b}" for a, b in ((r"\{\{", r"\}\}"), ("<%=?", "%>"), (r"\[\[", r"\]\]"), ("<<", ">>"), ("«", "»"), ("&lt;", "&gt;"), ("@@", "@@"), ("%%", "%%"), (r"#\{", r"\}")))
FIELD = re.compile(rf"^\W*[\w .-]{{1,40}}[\"']?\s*[:=]\s*[\"']?(?:{FREE_MARK})[\"']?[,;.]?\s*$")
SENTENCE_SLOT = re.compile(rf"(?<![^\s\"'(>*_])(?:{FREE_MARK})(?![^\s\"'),.;:!?<*_])")
ADDRESSED = re.compile(r"\b(?i:dear|hello|hi|welcome|by|from|to|for|at|with|contact|call|signed|sincerely|regards)[, ]+(?:\[[A-Z][A-Z _]{2,40}\]|<[A-Z][A-Z _]{2,40}>)(?![\[(:])")
# Capitals in brackets that are no names of values, as usage lines and logs have them.
NO_NAMES = re.compile(r"[\[<](?:OPTIONS?|ARGS?|ARGUMENTS?|FILES?|PATH|PATHS|DIR|COMMAND|URL|INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|TODO|WIP|OK|FAIL|PASS|HOST|PORT|IMAGE)[\]>]")
# Endings of texts and of settings in which such marks are no syntax.
TEXT_ENDINGS = "md markdown rst txt text adoc".split()
FIELD_ENDINGS = [*TEXT_ENDINGS, *"json toml ini cfg properties".split()]
CONTROL = re.compile(r"\{%-?\s*(?:for|if|else|end\w*|block|extends|include|set|macro)\b|<%-?\s*(?:if|for|end|\w+\.each)\b|\{\{[#/^>]")
COMMENT = re.compile(r"^\s*(?:#|//|--|/\*|\*|<!--|;|%)")
QUOTED_CODE = re.compile(r"`[^`]*$")


def _is_slot(name: str) -> bool:
    words = re.split(r"[ _-]+", name.lower())
    return any(w in SLOT_NOUNS or w in SLOT_YEARS for w in words)


def _free_slot(text: str, ending: str) -> bool:
    """Whether a mark around any name is the whole value of a field, or a word of a sentence."""
    if ending not in FIELD_ENDINGS or not FREE_HINT.search(text) or CONTROL.search(text):
        return False
    lines = [line.strip("\ufeff \t") for line in re.split(r"\r\n|\r|\n", text)]
    fences, fenced = _fences(lines), False
    for i, line in enumerate(lines):
        fenced ^= i in fences
        if fenced or "`" in line or not FREE_HINT.search(line):
            continue
        if FIELD.match(line) or (ending in TEXT_ENDINGS and not CODE.search(FREE.sub("x", line)) and SENTENCE_SLOT.search(line)):
            return True
        if ending in TEXT_ENDINGS and ADDRESSED.search(NO_NAMES.sub("", line)):
            return True
    return False


FREE = re.compile(FREE_MARK)
FREE_HINT = re.compile(r"\{\{|<%|\[\[|<<|«|&lt;|@@|%%|#\{|[\[<][A-Z]{2}")


def has_open_slot(text: str, path: str | None) -> bool:
    """Whether a mark that should have been replaced stands where a value belongs."""
    low = text.lower()
    base = (path or "").rsplit("/", 1)[-1].lower()
    endings = base.split(".")[1:]
    if any(e in TEMPLATE_ENDINGS for e in endings):
        return False
    if _free_slot(text, endings[-1] if endings else "txt"):
        return True
    if not any(noun in low for noun in (*SLOT_NOUNS, *SLOT_YEARS)):
        return False
    dollar_code = bool(endings) and endings[-1] in DOLLAR_SYNTAX
    for pattern in (MARKS, DOLLARS, BRACKETS, SHOUTED):
        for m in pattern.finditer(text):
            name = next((g for g in m.groups() if g), m.group(0))
            if not _is_slot(name):
                continue
            start = text.rfind("\n", 0, m.start()) + 1
            before = text[start : m.start()]
            if QUOTED_CODE.search(before) and before.count("`") % 2:
                continue  # quoted as an example
            comment = bool(COMMENT.match(text[start : m.end()]))
            if pattern is DOLLARS and dollar_code and not comment:
                continue
            if pattern is BRACKETS:
                if m.group(2) and f"</{name.lower()}" in low:
                    continue  # an element, not a mark
                if m.group(1) and name.lower() in SLOT_NOUNS and re.search(r"[\w)]$", before):
                    continue
            if pattern is MARKS and dollar_code and not comment and re.search(r"[\w'\"-]$", before) and m.group(0).startswith("{{"):
                continue  # doubled braces inside a format string
            return True
    return "your name" in low and any(YOUR_NAME.search(line) for line in text.split("\n"))


PLACE = ["size", "head", "template", "again"]


def residue_verdicts(documents: DataFrame, doc: str, text: str, path: str | None = None) -> DataFrame:
    """(doc_id, verdict): 'error', 'notice', 'filler' or 'slot', one row for each that a document has.

    - Null and empty texts and null ids give no rows; repeated rows count as further documents; whole texts of any length are read.
      A null path is a file without ending. Other columns are ignored, whatever they are called.
    """
    scratch = Scratch(documents.sparkSession, "residue")
    name = F.col(path) if path else F.lit(None).cast("string")
    rows = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"), name.alias("path")).filter("doc is not null and length(text) > 0")
    found = scratch.write(rows.mapInArrow(_scan, SCAN_DDL), "lines")
    lines = found.filter("size is not null")
    templates = lines.groupBy(*PLACE).agg(F.count("*").alias("docs"), F.count_if("alone").alias("alone"))
    said = scratch.write(templates.mapInArrow(_classify, CLASSED_DDL), "said")
    messages = lines.join(said, PLACE).filter("not (aside and verdict = 'notice')").select("doc", "verdict")
    slots = found.filter("size is null").select("doc", F.lit("slot").alias("verdict"))
    return messages.unionByName(slots).distinct().select(F.col("doc").alias("doc_id"), "verdict")


def residue_documents(documents: DataFrame, doc: str, text: str, path: str | None = None) -> DataFrame:
    """``doc_id`` of each document that has something in place of content."""
    return residue_verdicts(documents, doc, text, path).select("doc_id").distinct()
