"""Problem 10: template residue, filler, error pages and script notices.

Normalised lines are counted by host (the channel a note came through). Lines that recur in a share of a
host's records are boilerplate and are subtracted; what is left of a record is searched for evidence.
Code (fences, back-ticks) is no evidence, and a message counts only as a whole sentence, so that a note
that talks about an error page isn't one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _parser

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut

#: A line is boilerplate of a host if so many of its records, and this share of them, have it.
RECORDS, SHARE = 20, 0.01
#: Boilerplate lines of all hosts together that are sent to the workers; more of them are joined with the records.
LINES = 2_000_000

_FENCE = re.compile(r"```.*?```|(?m:^)[ \t]*~~~.*?\n[ \t]*~~~|```.*?(?:\n\s*\n|\Z)", re.S)
_TICKS = re.compile(r"(`+)[^`\n]+?\1")
_TAG = re.compile(r"</?(?:h[1-6]|noscript|p|div|span|b|strong|em|title|center|body|html|br|hr|pre|li|ul)\b[^<>]*>", re.I)
_LEAD = re.compile(r"^(?:[\s>*#•=|_]+|[-–—]\s+|\d+[.)]\s+|\[[ xX]\]\s*)+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")

# Template fields, fixed forms: what stands between the marks is a name of one to four short words.
_NAME = r"[$\w][\w.\-|]{0,30}(?: [\w.\-]{1,20}){0,3}"
FIELD = re.compile(
    rf"\{{\{{+\s*{_NAME}\s*\}}\}}+|[$#]\{{\s*{_NAME}\s*\}}|(?<![\w$#{{]){{\s*{_NAME}\s*\}}(?!\}})|\{{%\s*{_NAME}\s*%\}}|<%[=-]?\s*{_NAME}\s*-?%>"
    rf"|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|@@\w+@@|\$\$[A-Za-z]\w*\$\$|(?<![\w%])%[A-Za-z][\w.]*(?: \w+)?%(?!\w)|(?<!\w)__[A-Za-z]\w*?__(?!\w)"
    r"|(?<![\w~])~[A-Za-z]\w*~(?![\w~])|(?<!\w)XX_\w+_XX(?!\w)|\*\|[A-Z_]+\|\*|%\([a-z_]+\)s"
    rf"|[\[<]\s*(?:(?:insert|enter|add|type|fill in|your|tbd|todo|placeholder|xxx)\b[ :]*(?:[\w.\-]+ ?){{0,4}})(?<! )\s*[\]>]",
    re.I,
)

_MARKS = ("{", "[[", "<", "@@", "$$", "%", "__", "~", "XX_", "*|", *(f"[{pad}{w}" for pad in ("", " ") for case in (str.lower, str.upper, str.title) for w in map(case, ("insert", "enter", "add", "type", "fill", "your", "tbd", "todo", "placeholder", "xxx"))))

# Words of the usual filler, fixed values.
LOREM = frozenset(
    """ad adipiscing adipisicing aliqua aliquip amet anim ante aute cillum commodo condimentum consectetur consequat
    culpa cupidatat cursus dapibus deserunt diam dignissim do dolor dolore donec dui duis egestas eiusmod elit enim esse est
    et etiam eu euismod ex excepteur exercitation facilisi facilisis faucibus fermentum fugiat id imperdiet in incididunt
    integer ipsum irure labore laboris laborum lacinia laoreet lectus libero lobortis lorem luctus magna malesuada massa
    mattis mauris maecenas metus minim mollit morbi nec neque nibh nisi non nostrud nulla nullam nunc occaecat odio officia orci
    ornare pariatur pellentesque phasellus placerat porta porttitor posuere pretium primis proident proin pulvinar purus quam quis
    quisque reprehenderit rhoncus sagittis sapien scelerisque sed semper sint sit sodales sollicitudin sunt suspendisse tellus tempor tempus
    tincidunt tortor tristique turpis ullamco ultrices ultricies urna ut varius vehicula vel velit veniam vestibulum vitae
    vivamus viverra volutpat voluptate""".split()
)
_FILLER = (
    r"(?:your|sample|some|add|insert|dummy|placeholder|example|more|a short)(?: \w+){0,4} goes here\b.*",
    r"(?:this is|here is) (?:a |an |some |just )*(?:dummy|sample|placeholder|filler|example)(?: \w+)? (?:paragraph|text|sentence|content|page|title)\b.*",
    r"(?:sample|dummy|placeholder|filler) (?:text|paragraph|content)(?: here)?",
    r"(?:please )?replace (?:this|it|me)(?: \w+)? with (?:your|the) .*",
    r"(?:type|write|enter|add|put) your (?:own )?(?:text|title|content|description|message) here\b.*",
    r"(?:hier steht|dies ist) (?:ein )?(?:blindtext|platzhaltertext|beispieltext)\b.*|texte? (?:d'exemple|de remplissage)\b.*|texto de (?:ejemplo|relleno)\b.*|testo (?:di esempio|segnaposto)\b.*|примерен текст\b.*",
)
# Messages in the languages of the corpus, fixed values; each stands for a whole sentence.
_PLACE = r"(?:page|file|resource|address|url|site|content|document|folder|link|item)"
_STATE = r"(?:page )?(?:not found|missing|forbidden|unauthori[sz]ed|bad gateway|bad request|gone|(?:service|page|site|content) (?:temporarily )?unavailable|(?:internal )?server error|internal error|gateway time-?out|too many requests|access (?:is |was )?(?:denied|forbidden))"
_MESSAGE = (
    _STATE,
    rf"(?:the|this|that|your) {_PLACE}(?: that)?(?: you (?:have )?(?:requested|typed|asked for|are looking for|were looking for))? (?:could not|cannot|can't|can not|was not|wasn't|is not|isn't|does not|doesn't|no longer) (?:be )?(?:found|reached|loaded|displayed|opened|exist|available|shown)\b.*",
    r"you (?:do not|don't) have (?:the |any )?(?:permissions?|rights?|access|privileges)\b.*",
    r"you (?:are|were) not (?:allowed|authori[sz]ed|permitted) to (?:see|view|access|open|read|enter)\b.*",
    r"your session (?:has |is )?(?:expired|timed out|ended)\b.*",
    r"something went wrong\b.*",
    r"(?:we|the server|your browser) (?:could not|couldn't|cannot|can't|was unable to|were unable to) (?:load|find|show|display|reach|open|complete|process)\b.*",
    r"(?:our|the) \w+(?: \w+)? (?:is|are) busy (?:fixing|working on|repairing)\b.*",
    r"(?:the|your) (?:request|connection|page) (?:took too long|timed out|has timed out|was reset|was closed|was refused|could not be completed)\b.*",
    r"please (?:wait (?:a|some|for)\b.* (?:reload|refresh|try again)|try again (?:later|in)|reload (?:the|this) page|log in again to)\b.*",
    r"an (?:unexpected|internal|unknown) (?:condition|error)\b.*",
    r"(?:the|this) (?:server|service|host|site|upstream host|upstream server|application) (?:is|was) (?:temporarily|currently|not|down|unable|unavailable)\b.*",
    r"(?:the|this) (?:upstream )?(?:server|host) (?:sent|gave|returned) (?:no|an invalid)\b.*",
    r"(?:die (?:angeforderte |gewünschte |gesuchte )?seite (?:wurde|konnte|existiert|ist)\b.*nicht\b.*|zugriff (?:verweigert|nicht gestattet)|sie haben keine (?:berechtigung|rechte)\b.*|(?:der|dieser) (?:dienst|server) ist (?:vorübergehend|derzeit|zurzeit|momentan) nicht\b.*)",
    r"(?:la page (?:que vous avez )?demandée\b.*introuvable\b.*|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|vous n'avez pas (?:le droit|la permission|l'autorisation)\b.*|(?:le|ce) (?:service|serveur|site) est (?:temporairement|momentanément|actuellement) (?:indisponible|inaccessible)\b.*)",
    r"(?:no hemos encontrado la página\b.*|página no encontrada|acceso (?:denegado|prohibido)|(?:usted )?no tiene(?:s)? (?:permiso|autorización)\b.*|el (?:servicio|servidor) no está disponible\b.*)",
    r"(?:la pagina (?:richiesta|cercata)\b.*non\b.*|pagina non trovata|accesso (?:negato|vietato)|non (?:hai|ha|avete) (?:il permesso|l'autorizzazione|i permessi)\b.*|il (?:servizio|server) (?:non è (?:al momento )?disponibile|è temporaneamente)\b.*)",
    r"(?:търсената страница не\b.*|страницата не (?:беше|е) намерена\b.*|достъпът? (?:е )?отказан\b.*|нямате (?:право|права|достъп|разрешение)\b.*|(?:услугата|сървърът) (?:е временно|временно не|не е достъп)\b.*)",
)
_SCRIPT = r"(?:java ?script|scripts?|scripting|cookies?)"
_NOTICE = (
    rf"(?:you (?:need|have|must)(?: to)? |please |you'll need to )?(?:enable|turn on|switch on|activate|allow|accept) (?:java ?script|scripts|scripting|cookies)\b.*",
    rf"{_SCRIPT}(?: and {_SCRIPT})? (?:is|are|must be|needs? to be|has to be|have to be) (?:currently )?(?:switched off|turned off|turned on|disabled|blocked|required|enabled|needed|off)\b.*",
    rf"this (?:site|page|app|application|content|website) (?:requires|needs|isn't available|is not available|won't work|will not work|does not work|doesn't work|works best)\b.*\b{_SCRIPT}\b.*",
    r"your browser (?:did not|didn't|does not|doesn't) (?:run|support|allow|execute|accept)\b.*\b(?:script|javascript|cookies)\b.*",
    r"(?:checking|verifying) your browser\b.*",
    r"bitte (?:aktivieren|erlauben|schalten) sie (?:javascript|skripte|cookies)\b.*|(?:javascript|cookies) (?:ist|sind|muss|müssen)\b.*(?:deaktiviert|aktiviert|erforderlich|abgeschaltet)\b.*",
    r"veuillez (?:activer|autoriser|accepter) (?:le |les )?(?:javascript|scripts|cookies)\b.*|(?:javascript|les cookies) (?:est|sont|doit|doivent)\b.*(?:désactivés?|activés?|requis|nécessaires?)\b.*",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita|acepte) (?:el |las |los )?(?:javascript|scripts|cookies)\b.*|(?:javascript|las cookies) (?:está|están|debe|deben)\b.*",
    r"per (?:vedere|visualizzare|usare)\b.*(?:attivare|abilitare|accettare) (?:javascript|gli script|i cookie)\b.*|(?:attiva|abilita|attivare|abilitare|accetta) (?:javascript|gli script|i cookie)\b.*",
    r"моля,? (?:включете|активирайте|разрешете|приемете) (?:javascript|скриптовете|бисквитките)\b.*|за да видите тази страница\b.*javascript\b.*",
)
_CODE = r"(?:(?:internal |http |server )?(?:error|code|status|http|fehler|erreur|errore|грешка) ?:?(?: code)? ?)?[45]\d\d"
_OPENING = rf"(?:(?:sorry|oops|whoops|ooops|uh[- ]?oh|hm+)[,!.:]* )?(?:{_CODE}\s*[-–—:.,]*\s*)?(?:{_STATE}\s*[-–—:.,]+\s*)?(?:(?:sorry|oops|whoops)[,!.:]* )?"
_END = r"(?:\s*\([45]\d\d\))?[\s.!?…*]*"


def _whole(parts: tuple[str, ...], opening: str = "") -> re.Pattern:
    return re.compile(f"{opening}(?:{'|'.join(parts)}){_END}")


ERROR, NOTICE, FILLER = _whole(_MESSAGE, _OPENING), _whole(_NOTICE, _OPENING), _whole(_FILLER)
CODED = re.compile(rf"(?:(?:internal |server )?(?:error|fehler|erreur|errore|грешка) ?[45]\d\d ?[:–-] .+|[45]\d\d {_STATE}\b.*|{_STATE} \([45]\d\d\).*){_END}")
#: Alone these prove nothing; a record of which nothing else is left is an error page.
_WEAK_WORDS = ("oops", "whoops", "retry", "reload", "try again", "nginx", "apache", "loading", "please wait")
WEAK = re.compile(rf"(?:{'|'.join((_CODE, *_WEAK_WORDS))}){_END}")



def _needed(tree) -> frozenset[str] | None:
    """Words of which every match of a parsed pattern contains one; None where there is no such set."""
    best, run, sets = None, "", []

    def end():
        nonlocal run
        sets.append(frozenset([w]) if (w := max(run.split(), key=len, default="")) else None)
        run = ""

    for op, arg in tree:
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        end()
        if op is _parser.SUBPATTERN:
            sets.append(_needed(arg[3]))
        elif op is _parser.BRANCH:
            parts = [_needed(x) for x in arg[1]]
            sets.append(None if None in parts else frozenset().union(*parts))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
            sets.append(_needed(arg[2]))
    end()
    for x in sets:
        if x and (best is None or (min(map(len, x)), -len(x)) > (min(map(len, best)), -len(best))):
            best = x
    return best


def anchors(*patterns: str) -> frozenset[str]:
    """Words of which each text that one of the patterns matches contains one, derived from the patterns themselves."""
    found = [_needed(_parser.parse(p)) for p in patterns]
    if None in found:
        raise ValueError(f"no word stands in every match of {patterns[found.index(None)]}")
    return frozenset().union(*found)


#: A text without any of these, and without a number of an error, has no message; it isn't read for messages.
_NUMBER = re.compile(r"[45]\d\d")
ANCHORS = anchors(*_MESSAGE, *_NOTICE, *_FILLER, *_WEAK_WORDS)


def _automaton(words) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in words:
        a.add_word(word, 1)
    a.make_automaton()
    return a


_anchored = _automaton(ANCHORS)
_KEYS = re.compile(r"[asdfjklqwer]{2,}")
_LETTER_WORD = re.compile(r"[^\W_]+")


def normal(line: str) -> str:
    """The line as it is counted: lower case, digits as 0, one blank between words."""
    return re.sub(r"\d", "0", re.sub(r"\s+", " ", line.strip())).lower()


def _repeats(w: list[str]) -> bool:
    if len(w) < 4 or not any(x.isalpha() for x in w):
        return False
    if len(set("".join(w))) == 1:
        return True
    return any(all(w[i] == w[i - p] for i in range(p, len(w))) for p in range(1, min(3, len(w) // 2) + 1)) and sum(map(len, w)) > 7


def _keystrokes(w: list[str]) -> bool:
    """Words struck on a few neighbouring keys: the letters of one row half, hardly a vowel pattern of any language."""
    if len(w) < 3 or not all(_KEYS.fullmatch(x) for x in w):
        return False
    letters = "".join(w)
    odd = sum(bool(re.search(r"[^aeiou]{3}|(.)\1|[jkq][^aeiou]|[wf][dkjlsf]", x)) for x in w)
    return len(letters) >= 10 and odd >= max(2, len(w) // 2)


def line_kinds(line: str, messages: bool = True) -> set[str]:
    """Kinds of evidence of one line outside of code: error, notice, filler; weak is no evidence by itself."""
    bare = re.sub(r"\s+", " ", _LEAD.sub("", _TAG.sub(" ", line))).strip(" *_").lower()
    bare = _LEAD.sub("", bare)
    if not bare:
        return set()
    kinds = set()
    for part in dict.fromkeys((bare, *_SENTENCE.split(bare))):
        if messages:
            if ERROR.fullmatch(part) or CODED.fullmatch(part):
                kinds.add("error")
            elif NOTICE.fullmatch(part):
                kinds.add("notice")
            elif FILLER.fullmatch(part):
                kinds.add("filler")
            elif WEAK.fullmatch(part):
                kinds.add("weak")
        w = _LETTER_WORD.findall(part)
        if len(w) >= 4 and sum(x in LOREM for x in w) >= 0.75 * len(w) or _repeats(w) or _keystrokes(w):
            kinds.add("filler")
    return kinds


def residue_kinds(text: str, boilerplate: frozenset[int] = frozenset(), heading: int = 0, varied: frozenset[int] = frozenset()) -> list[str]:
    """Kinds of evidence in what is left of a text without code and boilerplate lines, sorted.

    Boilerplate is subtracted only from a record that has content of its own: where nothing but evidence is left
    below the first `heading` lines (the title), the recurrent lines are the record, and are searched too. Recurrent
    lines of `varied` have other digits in other records, so they are content unless they are evidence.
    """
    if not text:
        return []
    prose = _TICKS.sub(" ", _FENCE.sub("\n", text)) if "`" in text or "~~~" in text else text
    plain = "\n".join(_TAG.sub(" ", line) for line in prose.splitlines()) if "<" in prose else prose
    low = plain.lower()
    messages = next(iter(_anchored.iter(low)), None) is not None or _NUMBER.search(low) is not None
    kinds, weak, rest, own, recurrent = set(), False, 0, len(prose.split()) < len(text.split()), []

    for i, line in enumerate(prose.splitlines()):
        if not line.strip():
            continue
        if boilerplate and (x := spark_hash(normal(line))) in boilerplate:
            recurrent.append(line)
            own = own or i >= heading and x in varied and not line_kinds(line, messages)
            continue
        found = line_kinds(line, messages)
        if found == {"weak"}:
            weak = True
        elif not found:
            rest += 1
            own = own or i >= heading
        kinds |= found - {"weak"}
    if recurrent and not own:
        again = [line_kinds(line, messages) for line in recurrent]
        kinds |= set().union(*again) - {"weak"}
        weak = weak or {"weak"} in again and all(again)
    if any(mark in prose for mark in _MARKS) and FIELD.search(prose):
        kinds.add("field")
    if weak and not kinds and not rest:
        kinds.add("error")
    return sorted(kinds)


def recurrent_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, lines, varied): the hashes of each host's boilerplate lines, and of those whose digits differ between records;
    at most (lines of a record) / SHARE of a host."""
    def spaced(line):
        return F.lower(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), "^ | $", ""))

    def with_digits(line):
        return F.when(F.contains(line, F.lit("0")), F.xxhash64(F.element_at("own", F.array_position("all", line).cast("int"))))

    lines = (
        docs.where(F.col(text).isNotNull())
        .select(F.coalesce(F.col(host), F.lit("")).alias("h"), F.transform(F.split(text, r"\R+"), spaced).alias("own"))
        .select("h", "own", F.transform("own", lambda x: F.regexp_replace(x, r"\d", "0")).alias("all"))
        .select("h", F.explode(F.transform(F.array_distinct("all"), lambda x: F.struct(x.alias("l"), with_digits(x).alias("d")))).alias("s"))
        .where(F.col("s.l") != "")
        .groupBy("h", F.xxhash64("s.l").alias("x"))
        .agg(F.count("*").alias("count"), (F.min("s.d") != F.max("s.d")).alias("varies"))
    )
    sizes = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("h")).agg(F.count("*").alias("n"))
    many = lines.where(F.col("count") >= RECORDS).join(sizes, "h").where(F.col("count") >= SHARE * F.col("n"))
    return many.groupBy("h").agg(F.collect_list("x").alias("lines"), F.collect_list(F.when(F.col("varies"), F.col("x"))).alias("varied"))


def residue_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, kinds) of every record to exclude; kinds are of error, field, filler, notice.

    Null and empty texts are no cases. Whole texts are read; a record's host may be null (one host of its own).
    A text that begins with the record's `title` has it for its heading.
    """
    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("h"), F.col(text).alias("t"), title.alias("head"))
    rows = rows.where(F.col("t").isNotNull() & (F.col("t") != ""))
    lines = cut(recurrent_lines(docs, text, host))
    schema = "doc_id long, kinds array<string>"

    def kinds_of(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """known(batch) gives the boilerplate lines of each row's host and those that vary."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, kinds = [], []
                for doc, text_, head, (gone, differ) in zip(*(batch.column(i).to_pylist() for i in range(3)), known(batch), strict=True):
                    if found := residue_kinds(text_, gone, len(head.splitlines()) if head and text_.startswith(head + "\n") else 0, differ):
                        ids.append(doc)
                        kinds.append(found)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "kinds"])

        return run

    if (lines.agg(F.sum(F.size("lines"))).first()[0] or 0) <= LINES:  # no text is shuffled
        table = {r["h"]: (frozenset(r["lines"]), frozenset(r["varied"])) for r in lines.collect()}
        sent = docs.sparkSession.sparkContext.broadcast(table)
        none = (frozenset(), frozenset())
        return rows.select("doc_id", "t", "head", "h").mapInArrow(kinds_of(lambda batch: [sent.value.get(h, none) for h in batch.column(3).to_pylist()]), schema)
    seen: dict[tuple, frozenset] = {}

    def joined(batch: pa.RecordBatch) -> list[tuple[frozenset, frozenset]]:
        return [tuple(seen.setdefault(k, frozenset(k)) for k in (tuple(a or ()), tuple(b or ()))) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]

    return rows.join(lines, "h", "left").select("doc_id", "t", "head", "lines", "varied").mapInArrow(kinds_of(joined), schema)


def spark_hash(line: str) -> int:
    """xxhash64 as Spark computes it (seed 42, signed)."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h
