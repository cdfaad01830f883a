"""Problem 3: unfinished templates, filler, error messages and demands for scripts.

What recurs on a site is counted by host and subtracted with the rest of its
furniture; the residual of each record is then searched for evidence. Code is
not evidence, and an error, filler or demand counts only where no real text
stands beside it. Messages of unknown wording are known by their recurrence: they
are all that is left of records of several hosts.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.boilerplate import Classifier, Pages, parted
from folioforge.llm.sites import folded, line_key, skeleton, slices
from folioforge.runtime import cut

# Names that templates give their fields.
FIELDS = (
    "name, first name, last name, recipient, product, due date, sum, city, date, address, order total, your address, your name, company name, insert title here, title, "
    "nombre, dirección, razón social, fecha límite, producto, importe total, insertar título, ciudad, "
    "prénom, nom, nom société, adresse, montant total, date échéance, produit, insérer le titre, ville, "
    "vorname, nachname, frist, betrag, firmenname, anschrift, gesamt betrag, empfänger, titel hier einfügen, stadt"
)
FIELD = frozenset(skeleton(w) for w in FIELDS.split(", "))
#: Brackets that only templates use, and those that clean text uses too.
PLAIN_MARKS = re.compile(r"\{\{\s*[^{}\n]{1,40}\}\}|[$#]\{[^{}\n]{1,40}\}|%%[^%\n]{1,40}%%|@@[^@\n]{1,40}@@|<%=?[^%\n]{1,40}%>")
SHARED_MARKS = re.compile(r"\[\[([^\[\]\n]{1,40})\]\]|\[([^\[\]\n]{2,40})\](?![(\[])|«([^«»\n]{1,40})»|<([^<>\n]{2,40})>|\{([^{}\n]{2,40})\}|(?<!\w)__(\w[^_\n]*(?:_[^_\n]+)*)__(?!\w)")
# Prompts that stand until somebody writes, in skeleton form.
PROMPTS = frozenset(
    skeleton(w)
    for w in (
        "Click to add title|Click to add text|Type the subtitle|Your text here|Heading goes here|Insert text here|TITLE_PLACEHOLDER|TEXT_PLACEHOLDER|[object Object]|undefined|null|NaN|TBD|TODO|"
        "Texte à remplacer|Votre texte ici|Cliquez pour ajouter un titre|Hier Text eingeben|Ihr Text hier|Titel hinzufügen|Escriba aquí su texto|Su texto aquí|Haga clic para agregar título"
    ).split("|")
)
# Vocabulary of filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua nulla velit urna augue justo lectus "
    "massa nibh porta quis risus vitae vel nunc eget arcu mauris ac ante purus tellus sapien turpis vestibulum viverra".split()
)
KEYS = frozenset("asdf qwer jkl jklö sdf dfg hjkl qwertz qwerty xxx xxxx bla blah foo bar baz test tests".split())
# What servers and scripts say, in skeleton form.
ERROR = re.compile(
    r"\berror \d{3}\b|\b(?:http|status|code)\W{0,3}[45]\d\d\b|^\W*[45]\d\d\W+[a-z ]{3,30}$|something went wrong|could not be (?:loaded|found|reached)|unexpected error|\b\d{3}\b.{0,3}(?:error|page not found|internal|forbidden|bad gateway)|page not found|internal server error|bad gateway|gateway time-?out|access denied|permission denied|forbidden"
    r"|too many requests|session (?:has )?expired|error establishing|connection to the (?:data store|database)|moved or never existed|be back soon|under maintenance|cannot be reached|service unavailable|checking that you are human|are you a robot"
    r"|erreur \d{3}|page introuvable|service indisponible|acc\*s refus\*|session a expir\*|site en maintenance"
    r"|fehler \d{3}|seite nicht gefunden|nicht erreichbar|zugriff verweigert|sitzung ist abgelaufen|wartungsarbeiten"
    r"|error \d{3} del|p\*gina no encontrada|servicio no disponible|acceso denegado|sesi\*n ha caducado|en mantenimiento"
)
ADVICE = re.compile(
    r"request id|please (?:reload|refresh)|^(?:nginx|apache|cloudflare|openresty)\b|^vorgang\W|^refer[ae]n[cz](?:ia|e|)\b|^r\*f\*rence|handler\.\w+ \(line|try again|tell the administrator|permission to view|may be mistyped|file was removed"
    r"|contactez l|v\*rifiez l|revenez plus tard|pr\*fen sie|wenden sie sich|sp\*ter|avise a la|compruebe la|vuelva m\*s tarde|^ref(?:erenz|erencia|erence)?\W"
)
DEMAND = re.compile(
    r"(?:enable|turn on|switch on|allow|activate) (?:javascript|scripts?|scripting)|scripts are (?:blocked|disabled|required)|javascript (?:is|must be) |(?:does not|doesn.t) support javascript|allow scripts"
    r"|activez (?:javascript|les scripts)|exige que les scripts|aktivieren sie javascript|ohne skripte|skripte einschalten|active javascript|requiere que los scripts|habilite javascript"
)
MARK = re.compile(r"[{%@<\[«_｛％＠＜［＿]")
CODE_FENCE, INLINE = re.compile(r"^\s*(?:```|~~~)"), re.compile(r"`[^`\n]*`")
WORDS = re.compile(r"[^\W\d_]{2,}")
SENTENCES = re.compile(r"(?<=[.!?])\s+")
#: A greeting or label of a few words around a bracket.
ADDRESSED = re.compile(r"^(?:[^\W\d_]+ ){1,3}[\[<«{][^\W\d_]+(?:[ _-][^\W\d_]+){0,3}[\]>»}][,:!]$")
#: Signs of Markdown around a line, and characters of the longest prompt.
MARKS, LONGEST = "#*_>- \t", max(map(len, PROMPTS))
#: Words of real text beside which a message is only a notice.
REAL = 12
#: The share of a residual that filler must make up.
MOSTLY = 0.5
#: Words of a residual that may be a message of unknown wording, and the texts and hosts that must be left with each of its lines.
SHORT, LEAST_TEXTS, LEAST_HOSTS = 40, 5, 3


def residual(text: str, host: str | None, web: bool, often: frozenset[int] = frozenset(), model: Classifier | None = None) -> tuple[list[str], list[str]]:
    """The lines of ``text`` without its site's furniture and without code, and those that only do not recur on its site."""
    lines = text.split("\n")
    gone, again = removed(lines, host, web, often, model or Classifier())
    return outside_code(lines, gone), outside_code(lines, again)


def removed(lines: list[str], host: str | None, web: bool, often: frozenset[int], model: Classifier) -> tuple[set[int], set[int]]:
    """Numbers of the lines of a record that are its site's furniture, and of those that recur there; none without a URL."""
    return parted(lines, host, often, model) if web else (set(), set())


def outside_code(lines: list[str], gone: set[int]) -> list[str]:
    """``lines`` without those of the numbers ``gone``, without code and blank ones."""
    out, fenced = [], False
    if not any("```" in x or "~~~" in x for x in lines):
        return [x for no, x in enumerate(lines) if x and no not in gone and not x.isspace()]
    for no, line in enumerate(lines):
        if CODE_FENCE.match(line):
            fenced = not fenced
        elif not fenced and no not in gone and line and not line.isspace():
            out.append(line)
    return out


def is_field(inside: str) -> bool:
    """Whether what stands between brackets is the name of a field rather than text."""
    s = inside.strip()
    if skeleton(re.sub(r"[_.]", " ", s)) in FIELD:
        return True
    return bool(re.fullmatch(r"[^\W\d]+(?:[_.][^\W\d]+)+|[A-Z]{3,}(?:_[A-Z]+)*", s)) and not s.startswith(("http", "www"))


def placeholder(line: str) -> bool:
    if not MARK.search(line):
        return False
    s = INLINE.sub("", folded(line))
    if PLAIN_MARKS.search(s) or ADDRESSED.match(s.strip()):
        return True
    return any(is_field(next(g for g in m.groups() if g)) for m in SHARED_MARKS.finditer(s) if any(m.groups()))


def symbols(line: str) -> bool:
    letters = sum(c.isalnum() for c in line)
    return letters < 0.3 * len(line.replace(" ", ""))


def evidence(lines: list[str], others: list[str] | None = None, words: Counter | None = None) -> str | None:
    """What makes a residual no real content: placeholder, prompt, filler, error or demand; None for real content.

    A placeholder counts in all lines that do not recur on the site, ``others``, where
    they are given: no furniture that a page has for itself holds any. ``words`` are
    the counts of what stands between spaces in ``lines``, where they are known.
    """
    if any(placeholder(x) and not symbols(x) and not x.lstrip().startswith("|") for x in (others if others is not None else lines)):
        return "placeholder"
    if not lines:
        return None
    if words is None:
        words = Counter("\n".join(lines).lower().split())
    if filler([x for x in lines if not x.lstrip().startswith("#")] or lines, words):
        return "filler"
    if prompted(lines):
        return "prompt"
    return message(lines)


def bone(line: str) -> str:
    """A line's skeleton without the signs of Markdown around it."""
    return skeleton(line.strip(MARKS))


def message(lines: list[str]) -> str | None:
    """Whether there are errors, demands or advice, and at most REAL words of text beside them; ends as soon as there are more.

    Sentences are judged one by one: a long text that mentions an error has others.
    """
    errors = demands = advice = other = real = 0
    for x in lines:
        for part in SENTENCES.split(x):
            b = bone(part)
            error, demand, more = bool(ERROR.search(b)), bool(DEMAND.search(b)), bool(ADVICE.search(b))
            errors, demands, advice = errors + error, demands + demand, advice + more
            if not (error or demand or more):
                other += 1
                real += _real(part, x)
                if real > REAL:
                    return None
    if errors or demands or advice >= 2 or advice and not other:
        return "demand" if demands and not errors else "error"
    return None


def prompted(lines: list[str]) -> bool:
    """Whether there are prompts and at most REAL words of text beside them; ends as soon as there are more."""
    found, real = False, 0
    for x in lines:
        bare = x.strip(MARKS)
        # No ASCII text longer than the prompts is one.
        if not (len(bare) > LONGEST and bare.isascii()) and skeleton(bare) in PROMPTS:
            found = True
        else:
            real += _real(x, x)
            if real > REAL:
                return False
    return found


def _real(part: str, line: str) -> int:
    """Words of ``part`` of a line of text, which is no heading and no entry of a list."""
    return 0 if line.lstrip().startswith(("#", "- ", "* ", "[")) else len(WORDS.findall(part))


def filler(lines: list[str], words: Counter) -> bool:
    """Whether filler vocabulary or one repeated phrase makes up most of the text; signs at a word's end cost a few matches."""
    size = words.total()
    if size < 4:
        return False
    if size < 60:
        # Short texts count without headings and exactly.
        words = Counter(WORDS.findall("\n".join(lines).lower()))
        size = words.total()
    if size and any(sum(words[w] for w in known if w in words) >= MOSTLY * size for known in (LOREM, KEYS)):
        return True
    # One phrase over and over has next to no vocabulary.
    if len(words) > max(6, size // 4):
        return False
    said = [s.strip().lower() for x in lines for s in re.split(r"(?<=[.!?])\s+", x) if s.strip()]
    return len(said) >= 4 and len(set(said)) <= max(1, len(said) // 4) and all(len(s.split()) <= 6 and s[-1] in ".!?" for s in said)


def last_words(lines: list[str]) -> list[int] | None:
    """Keys of the lines that are left of a record with nothing but a few words; None for lists, tables and any longer text."""
    said = [x for x in lines if not x.lstrip().startswith("#")]
    if not said or any(x.lstrip().startswith(("|", "- ", "* ", "+ ", "[")) or "\t" in x or x.lstrip()[:1].isdigit() for x in said) or sum(len(x.split()) for x in said) > SHORT:
        return None
    return sorted({line_key(x) for x in said})


def judged(found: Pages) -> DataFrame:
    """``doc_id, evidence`` of each record of ``found`` (see boilerplate.pages); null evidence means real content.

    Null and blank texts give no row, repeated rows repeated ones. Furniture is
    subtracted only from records with a URL; any host may hold any share of them.
    Short records whose every line is left of LEAST_TEXTS texts on LEAST_HOSTS
    hosts hold a message ('error') whatever its words.
    """
    sent = found.rows.sparkSession.sparkContext.broadcast(found.model)

    def run(batches):
        model = sent.value
        for batch in slices(batches):
            kinds, left, marks = [], [], []
            for text, host, web, keys in zip(*(batch.column(c).to_pylist() for c in ("markdown", "host", "web", "recurring"))):
                lines, others = residual(text, host, web, frozenset(keys or ()), model)
                kinds.append(evidence(lines, others))
                left.append(None if kinds[-1] or not web else last_words(lines))
                marks.append(None if left[-1] is None else xxhash.xxh3_64_intdigest("\n".join(lines).encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(kinds, pa.string()), pa.array(left, pa.list_(pa.int64())), pa.array(marks, pa.int64())], names=["doc_id", "host", "evidence", "left", "mark"])

    rows = found.rows.where(F.col("markdown").rlike(r"\S")).select("doc_id", "markdown", "host", "web", "recurring").mapInArrow(run, "doc_id string, host string, evidence string, left array<bigint>, mark bigint")
    rows = cut(rows)
    # Few records are that short; copies of one on a host count once.
    short = rows.where("left is not null").select("doc_id", "host", "left", "mark").distinct()
    lines = short.select("host", "left", "mark").distinct().select("host", F.explode("left").alias("line"))
    known = lines.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))
    said = short.select("doc_id", F.explode("left").alias("line")).join(known, "line").groupBy("doc_id").agg((F.min("n") >= LEAST_TEXTS).alias("often"), F.min("hosts").alias("hosts"))
    said = said.where(F.col("often") & (F.col("hosts") >= LEAST_HOSTS)).select("doc_id", F.lit("error").alias("said"))
    return rows.join(said, "doc_id", "left").select("doc_id", F.coalesce("evidence", F.when(F.col("left").isNotNull(), F.col("said"))).alias("evidence"))
