"""Template residue, filler, error pages and demands to allow scripts in place of content.

Each text is cut into sentences, and each sentence is masked: numbers, addresses, dates, the site's own
name and template fields become fixed marks. Equal masked sentences form groups by exact hash, and
each group is counted over the pages and sources it stands on. Recurrence decides: a group that stands
on several sources, on pages that are not copies of each other, is no content. If it carries a phrase
or a placeholder, it is a message (sentences that differ in one word, or in one clause, are one message); if not, it belongs to menus, notices and footers. A sentence that
recurs nowhere is content, unless a field was left open in it or it is filler. A document is residue
if what is left of it apart from heading, menu, notice and footer is mostly such messages.

Scale: text is masked and hashed where it is read; what is shuffled are hashes. Groups are combined on
the map side per (hash, page), so a message on a third of all pages costs no more than
others. Only documents with some sign of residue are joined back to the groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import use_checkpoints
from .texts import INVISIBLE, mended

#: Signs of a sentence by its own looks. PHRASE carries a phrase of messages and counts only if it recurs;
#: VARIANT is a sentence with a phrase but without one of its words.
VARIANT, CONTENT, HEADING, PHRASE, FIELD, FILLER = range(-1, 5)

# --- Fixed values: shapes of unfilled template fields ---
_NAME = r"[A-Za-z][A-Za-z]*(?:[_. ][A-Za-z]+){0,3}"
FIELDS = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|\$\{{\s*{_NAME}\s*\}}|%%{_NAME}%%|\[\[\s*{_NAME}\s*\]\]|__{_NAME}__"
    rf"|\$[A-Za-z][A-Za-z_.]*\$|#[A-Za-z][A-Za-z_.]*#|@[A-Za-z][A-Za-z_.]*@|\[(?:your|insert|enter|add)\s[^\]\n]{{1,40}}\]|(?<![\w\])])\[[A-Za-z]+(?:[_.][A-Za-z]+)*\](?!\()|(?<![\w$\{{])\{{[A-Za-z]+(?:[_.][A-Za-z]+)*\}}(?!\}})"
    rf"|(?:&lt;|<)(?!/)(?!(?:a|b|i|p|u|br|em|hr|h[1-6]|li|ol|td|th|tr|ul|div|img|pre|sub|sup|span|code|table|strong)(?:&gt;|>))[A-Za-z]+(?:[_.][A-Za-z]+)*(?:&gt;|>)",
    re.I,
)
_FIELD_SIGN = re.compile(r"[{}\[<%$#@]|__|&lt;")

#: Word stems of messages, filler and demands to allow scripts, in the corpus' languages.
PHRASES = """
error|not found|does not exist|doesn't exist|no longer|unavailable|denied|forbidden|permission|expired|gateway|timeout|time-out|timed out|too many requests|server|maintenance|being serviced|overload|try again|try once more|try later|blocked|banned|refused|failed|failure|invalid|bad response|bad request|went wrong|sorry|oops|apologies|unfortunately|bad luck|moved or|or moved|or removed|or deleted|has gone|not be located|not be loaded|not here any|was found under|lives at|no entry|no content|for request|of request|spelling of|traceback|be missing|nothing is|at this address|this link|request id|not allowed|exception|offline|is down|be patient|stack trace|session|database
script|browser|reload|one moment|loading|verifying|checking|content blocker|client-side
placeholder|dummy|our sample|some sample|sample heading|sample text|example|layout|your text|own words|replace this|insert|edit me|type something|item one|lorem|description of|goes here|paste|filler|demo|write the|write your|this block|this area|this box
fehler|nicht gefunden|existiert nicht|gibt es nicht|nicht mehr|nicht erreichbar|verweigert|gesperrt|abgelaufen|vorgang|oder gelöscht|wurde entfernt|fehlt dieses|wartung|datenbank|skript|es später|leider|hoppla|blindtext|mustertext|probetext|beispiel|platzhalter|überschrift|ihr text
erreur|introuvable|n'existe|n’existe|existe plus|plus disponible|indisponible|refusé|expiré|ou supprimé|été retiré|été supprimé|serveur|réessayer|désolé|faux texte|exemple|provisoire|à compléter|à remplacer|votre texte|base de données
no encontrad|no existe|no está|no aparece|ya no|denegad|caducad|servidor|el servicio|inténtelo|eliminad|retirad|lo sentimos|ejemplo|relleno|provisional|por completar|de prueba|su texto|base de datos
오류|찾을 수 없|없습니다|못했습니다|권한|일시적|다시 시도|삭제되었|이동된|만료|차단|죄송|자바스크립트|스크립트|예시|임시|견본|입력하세요|서버
"""
#: Words of the usual filler text.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur consec adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco ullam laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum tetur vestibulum pellentesque mauris vivamus nunc donec".split())
#: Words of pages that write about templates.
EXPLAINED = re.compile("in the template|template engine|code such as|is replaced|gets replaced|we write|plantilla|modèle on écrit|le modèle|vorlage|schreibt man|템플릿|서식|틀에")
#: What is typed to fill a box.
_MASHED = r"(?:asdf\w*|qwert?\w*|zxcv\w*|hjkl|blah|bla|x{3,9}|y{3,9}|z{3,9}|abc|foo|bar|baz|test|text)"
MASH = re.compile(rf"^(?:{_MASHED}\W+){{2,}}{_MASHED}\W*$", re.I)

_QUOTED = re.compile("[“„«\"`‘].{3,}[”“»\"`’]|(?:^|\\s)\\?\\S.+?\\S\\?")
_DATE = re.compile(r"\d{4}-\d\d?-\d\d?(?:[ T]\d\d?:\d\d(?::\d\d)?)?|\d\d?[./]\d\d?[./]\d{2,4}")
_ADDRESS_SIGN = re.compile(r"\w\.[a-z]|[/@]")
_ADDRESS = re.compile(r"https?://\S+|(?<![\w/])/[\w./-]+|\b[\w.-]+@[\w.-]+\.\w+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b")
_NUMBER = re.compile(r"\d+")
_CODE = re.compile(r"\b[a-z]+-?0\b")
_MARKS = re.compile("¤+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Words that hardly any text but filler has.
_LATIN_SIGN = re.compile("ipsum|dolor|amet|adipi|tempor|veniam|nostrud|aliqu|commodo|pariatur|sint|culpa|mollit|labor|magna|ullam|velit|quis|elit|nulla")
_INNER_END = re.compile(r"[.!?…]\s|[。！？]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[。！？])")
_CLAUSE = re.compile(r"[,;:] | [-–—] ")
_CLOSED = (".", "!", "?", "…", "。", "！", "？", ":", ";", ",")


@lru_cache(maxsize=1)
def _phrases():
    import ahocorasick

    found = ahocorasick.Automaton()
    for stem in re.split(r"[|\n]", PHRASES.strip()):
        found.add_word(stem, 1)
    found.make_automaton()
    return found


def mask(text: str, host: str) -> str:
    """The text's form: lower case, fields (at their length), dates, addresses, the host and numbers as marks."""
    if _FIELD_SIGN.search(text):
        text = FIELDS.sub(lambda m: " " + "¤" * len(m.group()) + " ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    text = text.lower()
    if host:
        text = text.replace(host, " § ")
    if _ADDRESS_SIGN.search(text):
        text = _ADDRESS.sub(" § ", text)
    if _NUMBER.search(text):
        text = _CODE.sub("0", _NUMBER.sub("0", _DATE.sub("0", text)))
    return text


def is_filler(sentence: str) -> bool:
    """Whether most words are those of the usual filler text."""
    found = _WORDS.findall(sentence)
    return len(found) >= 3 and sum(map(LATIN.__contains__, found)) >= 0.7 * len(found)


def sign(sentence: str, explained: bool = False) -> int:
    """What a masked sentence shows by its own looks; `explained`: its line tells how templates are written."""
    if "¤" in sentence:
        # prose that quotes a field or explains it is content
        return CONTENT if explained or any(c in sentence for c in "`“„«") else FIELD
    if next(_phrases().iter(sentence), None) is not None:
        return FILLER if is_filler(sentence) or MASH.match(sentence) else CONTENT if _QUOTED.search(sentence) else PHRASE
    return FILLER if _LATIN_SIGN.search(sentence) and is_filler(sentence) or MASH.match(sentence) else CONTENT


def sentences(masked: str) -> Iterator[tuple[str, int]]:
    """(sentence, sign) of all lines of a masked text. A first line that is no sentence is the heading."""
    first = True
    for line in masked.split("\n"):
        line = line.strip()
        if not line:
            continue
        heading, first = first and not line.endswith(_CLOSED), False
        parts = [line] if heading or not _INNER_END.search(line) else _SENTENCE.split(line)
        explained = "¤" in line and EXPLAINED.search(line) is not None
        for part in parts:
            if "  " in part:
                part = " ".join(part.split())
            kind = sign(part, explained)
            yield part, HEADING if heading and kind == CONTENT else kind


_LINE = pa.struct([("h", pa.int64()), ("chars", pa.int32()), ("kind", pa.int8()), ("unit", pa.int32())])
_DOC = "doc_id long, source string, page long, other long, lines array<struct<h:bigint,chars:int,kind:tinyint,unit:int>>"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _without_a_word(parts: list[str]) -> list[int]:
    digests = []
    for side in (parts, parts[::-1]):
        running = xxhash.xxh64()
        seen = [running.intdigest()]
        for word in side:
            running.update(word + " ")
            seen.append(running.intdigest())
        digests.append(seen)
    before, after = digests
    n = len(parts)
    return [_hash(f"{before[i]} {after[n - 1 - i]}") for i in range(n)] if n > 2 else []


def variants(sentence: str) -> list[int]:
    """Hashes of a sentence with a phrase, and of its clauses with one, each without one of its words:
    names and subjects vary within one message, and messages are put together from clauses."""
    out = _without_a_word(sentence.split(" "))
    clauses = _CLAUSE.split(sentence)
    if len(clauses) > 1:
        for clause in clauses:
            if next(_phrases().iter(clause), None) is not None:
                out += _without_a_word(clause.split(" "))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources = batch.column(0), batch.column(1).to_pylist()
        pages, others, ends, hashes, chars, kinds, units = [], [], [0], [], [], [], []
        for text, raw, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), sources, strict=True):
            host, longest, second, balance = (host or "").lower(), "", "", 0
            for unit, (part, kind) in enumerate(sentences(mask(mended(text, raw), host))):
                if kind == PHRASE:
                    wild = variants(part)
                    hashes += wild
                    chars += [0] * len(wild)
                    kinds += [VARIANT] * len(wild)
                    units += [unit] * len(wild)
                hashes.append(_hash(_MARKS.sub("¤", part) if "¤" in part else part))
                chars.append(len(part))
                kinds.append(kind)
                units.append(unit)
                balance += len(part) * ((kind == CONTENT) - (kind == PHRASE))
                if kind == CONTENT and len(part) > len(second) and part != longest:
                    longest, second = (part, longest) if len(part) > len(longest) else (longest, part)
            # what a page is known by: its longest sentence, for that itself the next; where it names the site,
            # or there is none, or most of the page looks like messages, the site
            for known, names in ((longest, pages), (second, others)):
                names.append(_hash(known + host if "§" in known or not known or balance < 0 else known))
            ends.append(len(hashes))
        made = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(chars, pa.int32()), pa.array(kinds, pa.int8()), pa.array(units, pa.int32())], fields=list(_LINE))
        lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(pages, pa.int64()), pa.array(others, pa.int64()), lines], names=["doc_id", "source", "page", "other", "lines"])


def judge_residue(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", raw_col: str | None = "raw_bytes", share: float = 0.5, template_share: float = 0.25, wide: int = 3) -> DataFrame:
    """One row per document: doc_id, source, residue_chars, content_chars, weak_chars, kind and is_residue.

    `share` is the part of the main text's characters that residue must make up (`template_share` where it
    has unfilled fields, as these stand beside filled-in text). A group recurs if it stands on `wide` pages
    that differ in their longest sentence, and on two sources at least. `weak_chars` are sentences with a
    phrase that recur nowhere: they are part of `content_chars`, but messages outweigh three times as many of them. Defined cases: null or
    empty texts and texts of menus only are no residue; a null source counts as one source; repeated ids
    are judged one by one; texts with broken characters are decoded anew from `raw_col`."""
    use_checkpoints(docs.sparkSession)
    broken = F.col(text_col).rlike("[\\uFFFD\\u0080-\\u00BF]|[\\u00C0-\\u00F4][\\u0080-\\u00BF\\u0152-\\u0178\\u02C6-\\u203A\\u20AC\\u2122]|\\p{L}\\?\\p{L}")
    raw = F.when(broken, F.col(raw_col)) if raw_col else F.lit(None).cast("binary")
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), raw.alias("raw")).mapInArrow(_cut, _DOC)
    cut = cut.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    place = F.coalesce(F.xxhash64("source"), F.lit(0))
    flat = cut.select(place.alias("place"), "page", "other", F.explode("lines").alias("l")).select("place", F.when(F.col("l.h") == F.col("page"), F.col("other")).otherwise(F.col("page")).alias("page"), "l.h", "l.kind").where(F.col("kind").isin(VARIANT, CONTENT, PHRASE))
    groups = flat.groupBy("h", "page").agg(F.min("place").alias("low"), F.max("place").alias("high")).groupBy("h").agg(F.count("*").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
    recurring = groups.where((F.col("pages") >= wide) & (F.col("low") < F.col("high"))).select("h", F.lit(True).alias("recurs"))
    # only documents with some sign of residue can be residue
    shown = F.exists("lines", lambda x: x["kind"] >= PHRASE)
    lines = cut.where(shown).select("row", F.explode("lines").alias("l")).select("row", "l.*")
    grouped = F.col("kind").isin(VARIANT, CONTENT, PHRASE)
    joined = lines.where(grouped).join(recurring, "h", "left").groupBy("row", "unit").agg(F.max("chars").alias("chars"), F.max("kind").alias("kind"), F.max(F.col("recurs").isNotNull()).alias("recurs"))
    chars = lambda when: F.coalesce(F.sum(F.when(when, F.col("chars"))), F.lit(0))
    is_, recurs = lambda k: F.col("kind") == k, F.col("recurs")
    sums = lines.where(~grouped).select("row", "unit", "chars", "kind", F.lit(False).alias("recurs")).unionByName(joined).groupBy("row").agg(
        chars(is_(PHRASE) & recurs).alias("message"), chars(is_(FIELD)).alias("template"), chars(is_(FILLER)).alias("filler"), chars(is_(PHRASE) & ~recurs).alias("weak"), chars(is_(CONTENT) & ~recurs).alias("content"))
    own = F.aggregate("lines", F.lit(0), lambda n, x: n + F.when(x["kind"] == CONTENT, x["chars"]).otherwise(0))
    full = cut.select("row", "doc_id", "source", F.when(~shown, own).otherwise(0).alias("content_chars")).join(sums, "row", "left").fillna(0)
    residue = F.col("message") + F.col("template") + F.col("filler")
    all_content = F.col("content_chars") + F.col("content") + F.col("weak")
    fields = F.col("template") > 0
    # beside recurring messages, a phrase in a wording of its own is half a sign: a quarter of both must recur
    clear = F.when(fields, all_content).otherwise(all_content - F.col("weak"))
    least = F.when(fields, F.lit(template_share)).otherwise(F.lit(share))
    is_residue = (residue > 0) & (residue >= least * (residue + clear)) & (residue >= template_share * (residue + all_content))
    kind = F.when(is_residue, F.when((F.col("template") >= F.col("message")) & (F.col("template") >= F.col("filler")), "template").when(F.col("filler") > F.col("message"), "filler").otherwise("message"))
    return full.select("doc_id", "source", residue.alias("residue_chars"), all_content.alias("content_chars"), F.col("weak").alias("weak_chars"), kind.alias("kind"), is_residue.alias("is_residue"))


def without_residue(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The documents that are not residue; those with a null id stay."""
    return docs.join(judged.where("is_residue").select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
