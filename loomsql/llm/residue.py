"""Template residue, filler, error pages and script notices.

Normalised lines of any length are counted by host, over distinct texts, in all documents. A line that recurs on a host,
or on several hosts, is boilerplate (navigation, footers) and is subtracted. The lines that remain are judged sentence by sentence:

* evidence: unfilled slots among few words of their own; filler; sentences that say in words of notices that something
  failed, is gone or closed, or that scripts must be on. A sentence is judged by what share of its words belongs to such
  notices (``CLASSES``, ``PLAIN``), not by whole phrases; a thing may have any name ("the plan viewer").
* nothing: no words, or words any notice has ("return to the start page");
* content: all else, so quoted or discussed messages leave the words around them as content.

A document is residue if it has evidence and no content.

Defined results: null, empty and blank texts are no cases; a null host counts as one host; copies of a text count once
for its lines; every input row is judged by itself; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Marks of template languages around a slot.
NAME = r"[\w .:'-]{1,60}?"
SLOT = re.compile(
    rf"\{{\{{\{{?\s*{NAME}\s*\}}?\}}\}}|\{{%-?\s*{NAME}\s*-?%\}}|<%=?\s*{NAME}\s*%>|[#$]\{{\s*{NAME}\s*\}}|\{{\s*{NAME}\s*\}}|\[\[\s*{NAME}\s*\]\]"
    rf"|\[(?:your|insert|enter|add|placeholder|todo)\b[\w .:'-]{{0,60}}\]|%%{NAME}%%|@@{NAME}@@|__(?=[^\W_]){NAME}(?<=[^\W_])__|<(?=[a-z_]){NAME}>",
    re.I,
)
#: Filler words of the customary pseudo-Latin text.
LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore "
    "duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris "
    "laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint "
    "sit sunt tempor ullamco ut velit veniam voluptate".split()
)

def _words(text: str) -> re.Pattern:
    """One of the words; a star stands for any ending."""
    return re.compile("|".join(w[:-1] + r"\w*" if w[-1] == "*" else w for w in text.split()))


#: Words by what they say in a notice (English, German, French, Spanish, Russian).
CLASSES = {
    "loss": _words(
        "error errors fatal exist moved deleted removed unpublished expired denied permission unavailable offline failed fails cannot can't couldn't found displayed "
        "shown loaded opened reached blocked timed longer gone wrong oops whoops maintenance respond exceeded timeout refused reset forbidden unauthori* "
        "fehler gefunden erreichbar verfügbar verweigert abgelaufen erreur erreurs introuvable indisponible refusé interdit expirée "
        "encontrado encontrada caducada expirada denegado disponible ошибк* найден* запрещ* закрыт* недоступ* истек*"
    ),
    "script": _words("javascript* ecmascript js script scripts scripting noscript skripte скрипт* сценари*"),
    "switch": _words(
        "enabl* activ* allow* permit* turn* switch* unblock* disabled deactivat* blocked need* requir* without support* must only works "
        "aktivier* deaktivier* erforderlich benötigt einschalten ohne activé* activez désactiv* requiert nécessit* sans requiere necesita habilit* desactiv* sin "
        "включ* отключ* треб* необходим*"
    ),
    "reload": _words("reload checking loading blocker laden recharg* recargu* перезагруз*"),
    "slot": _words(
        "title heading headline section body image figure photo caption paragraph text texts copy content contents description descriptions line lines words logo name message details "
        "placeholder platzhalter* sample dummy filler blind lorem ipsum texte textes contenu remplissage exemple texto contenido relleno ejemplo inhalt beispiel"
    ),
    "fill": _words("here goes add added replace edit click insert put enter type write written soon come* coming later announced determined defined max own hier folgt steht kommt später ici insérez venir bientôt aquí va proximamente"),
    "junk": _words("x{2,} asdf* qwert* bla blah foo bar baz tbd tba todo etc lorem test blindtext* beispieltext* platzhalter*"),
}
#: Words any sentence has, and words about pages and what to do about them.
PLAIN = _words(
    "a an and as are at be been before but by can could do does did doesn't don't for from has have he how i if in into is isn't it its like long many may more my no not of off oh on once or our please "
    "so sorry than that the then there these they this those to too until unless up us was we we're we've well when while who will with would you your yours yourself hasn't "
    "page pages document site website web file link address url region server service proxy gateway edge browser app application view viewer request requests requested asked looking code id ref reference "
    "incident ray trace traceback template rendered render store session login log sign account administrator admin webmaster contact persist* problem user users client connect* connection failure upstream database host system team "
    "side start home return go back find try again check retry refresh slow down wait visit see open opening load read use display order continue cookies reason http https seconds second minutes s ss ms h min bad short whole all built single anything features "
    "unexpected internal something went happen* occurred temporar* moment* currently shortly right now took under looks seems appears nothing first press run nginx apache varnish cloudflare "
    "der die das den dem des ein eine einen einer und oder ist sind nicht sie es bitte um zu von mit für auf kann können werden wird haben noch einmal minuten diese dieser dieses ihre vorübergehend "
    "seite adresse dienst versuchen prüfen fortzufahren angeforderte ansicht angezeigt geladen neu anmelden "
    "le la les l un une et ou est sont ne pas ce cette ces votre vous veuillez pour de du dans en réf sur à d être doit se demandée réessayer afficher navigateur momentanément "
    "el los las una y o es son su ha para por favor que del al esta este con navegador página solicitada sesión vuelva entrar ver resultado continuar funcionar inténtelo nuevo "
    "и не на в по для эта этот это вы пожалуйста сайт страниц* сервис* временно попробуйте позже браузер* сессия"
)
#: After these any two words may name a thing.
DETERMINER = _words("the this that your our requested any each all single a an of der die das diese dieser dieses ihre la le les cette ce votre el los las esta este su эта этот")
PHRASES = {s.phrase.lower().partition(" (")[0] for s in HTTPStatus if s >= 400} | {"unavailable", "internal error", "access denied", "permission denied"}
REASONS = re.compile(r"\b(?:%s)\b" % "|".join(sorted(map(re.escape, PHRASES), key=len, reverse=True)))
REASON_WORDS = frozenset(w for p in PHRASES for w in re.findall(r"[a-z']+", p))
STATUS = re.compile(r"(?:^|\(|\berror |\bcode |\bhttp |\bstatus |\bfehler |\berreur |\bошибка )[45]\d\d\b")
#: Writing without spaces, and what its notices say.
WIDE = re.compile(r"[\u3005-\u30ff\u3400-\u9fff\uac00-\ud7af]")
WIDE_CLASSES = {
    "loss": re.compile("見つかりません|存在しません|拒否|アクセスできません|不存在|找不到|未找到|拒绝|拒絕|无法|無法|不可用|찾을 ?수|거부|사용할 ?수"),
    "switch": re.compile("有効|無効|必要|启用|啟用|开启|開啟|允许|允許|需要|禁用|활성|필요|사용|허용"),
    "script": re.compile("java ?script|js|スクリプト|脚本|스크립트"),
}
SEPARATOR = re.compile(r"\s+[|·•]\s+")
SENTENCE = re.compile(r"(?<=[.!?。！？…])\s+|(?<=[。！？])")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Identifiers of a request, and names of files, columns and machines.
TRACE_ID = re.compile(r"\b(?=[0-9a-f-]*\d)[0-9a-f-]{4,40}\b")
NAMED = re.compile(r"\b[a-z0-9_-]+(?:[./_][a-z0-9_-]+)+\b|\b[a-z0-9-]*[a-z-]\d[a-z0-9-]*\b")
#: Tokens and tags that look like slots but mark up text.
TAG = re.compile(r"</?(?:eos|bos|pad|unk|sep|cls|mask|s|br|p|b|i|u|em|strong|div|span|li|ul|ol|td|tr|table|code|pre|hr|h[1-6]) ?/?>", re.I)
TIME = re.compile(r"\d{4}-\d\d(?:-\d\d)?|\d\d:\d\d(?::\d\d)?")
DIGIT = re.compile(r"\d")
MARK = "\ue000"
#: Stands for every host in the keys of lines that recur on several.
ANYWHERE = "\x00"
#: At most so many keys of boilerplate are sent to tasks.
MAX_SENT = 500_000


def normal(line: str) -> str:
    """A cleaned line for counting: without slots, white space single, dates alike. Other numbers count."""
    return TIME.sub("0", re.sub(r"\s+", " ", line.replace(MARK, " "))).strip()


@lru_cache(1 << 16)
def classes(word: str) -> tuple[frozenset, bool, bool]:
    """(classes of a word, whether it belongs to any sentence, whether it announces a thing)."""
    return frozenset(k for k, p in CLASSES.items() if p.fullmatch(word)), bool(PLAIN.fullmatch(word)) or word in REASON_WORDS, bool(DETERMINER.fullmatch(word))


def judge_sentence(s: str) -> str:
    """'evidence', 'nothing' or 'content' of one sentence in small letters with slots marked."""
    slots = s.count(MARK)
    words = WORD.findall(s.replace(MARK, " "))
    if slots:
        return "evidence" if len(words) <= 3 * slots + 2 else "content"
    if not words:
        return "nothing"
    if len(words) >= 2 and sum(w in LATIN for w in words) >= 0.8 * len(words) or words == ["lorem"]:
        return "evidence"
    bare = TRACE_ID.sub(" ", s) if DIGIT.search(s) else s
    named = len(NAMED.findall(bare))
    names = max(0, named - 1)  # words of names don't count, but for all names after the first
    if bare is not s or named:
        words = WORD.findall(NAMED.sub(" ", bare))
    if not words and not names:
        return "nothing"
    different = len(set(words))
    status = STATUS.match(s)
    said: set[str] = set()
    wide = False
    unknown = strange = names  # words that name no thing; words that are no notice's
    thing = 2 if status else 0
    most, most_strange = different // 8, max(2, different // 3)
    for w in words:
        if WIDE.search(w):
            here = [k for k, p in WIDE_CLASSES.items() if p.search(w)]
            said.update(here)
            wide = True
            unknown += not here or len(w) > 30
            continue
        of, plain, announces = classes(w)
        said |= of
        strange += not (of or plain or announces)
        if announces:
            thing = 2
        elif of or plain:
            thing = 0
        elif thing:
            thing -= 1
        else:
            unknown += 1
        if unknown > most or strange > most_strange:
            return "content"
    if "login" in words and "switch" in said:
        said.add("loss")
    if "junk" in said and all(classes(w)[0] & {"junk", "slot"} for w in words):
        return "evidence"
    if "loss" in said or REASONS.search(s) or different <= 12 and STATUS.search(s) or "script" in said and "switch" in said or "reload" in said and ("switch" in said or different <= 12):
        return "evidence"
    if "slot" in said and different <= 12 and not named and ("fill" in said and strange <= different // 5 or different <= 4 and not strange and s[-1] != ","):
        return "evidence"
    return "nothing" if not unknown and not wide and different <= 16 and (not strange or "switch" in said) else "content"


def cleaned(line: str) -> str:
    """One line in small letters with plain quotes, its entities resolved, its slots marked."""
    if "&" in line:
        line = html.unescape(line)
    if not line.isascii():
        line = unicodedata.normalize("NFKC", line).replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"')
    if "<" in line:
        line = TAG.sub(" ", line)
    if any(mark in line for mark in "{[<%@_"):
        line = SLOT.sub(MARK, line)
    return line.strip().lower()


def lines_of(text: str) -> list[str]:
    return [x for x in re.split("[\\r\\n\\v\\f\\x85\\u2028\\u2029]+", text) if x]


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_key(host: str, line: str) -> int:
    return _hash(f"{host}\n{line}")


def judge(text: str, host: str = "", known: frozenset | None = None) -> tuple[bool, list[tuple[int, int]]]:
    """(whether there is evidence, keys of the lines that hold content: with their host, and for any host).

    With ``known``, the keys of boilerplate, such lines are passed over and the first other line of content ends it: the
    text has content, whatever follows.
    """
    evidence, content = False, []
    for raw in lines_of(text):
        line = cleaned(raw)
        if not line:
            continue
        kinds = set()
        for part in SEPARATOR.split(line):
            for s in SENTENCE.split(part):
                kinds.add(judge_sentence(s) if s else "nothing")
            if "content" in kinds:
                break
        if "content" in kinds:
            form = normal(line)
            keys = line_key(host, form), line_key(ANYWHERE, form)
            if known is None or keys[0] not in known and keys[1] not in known:
                content.append(keys)
                if known is not None:
                    return evidence, content
        else:
            evidence |= "evidence" in kinds
    return evidence, content


def counted(text: str) -> set[str]:
    """Distinct normalised lines, as they are judged."""
    return {normal(cleaned(x)) for x in lines_of(text)} - {""}


def line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, host, text) -> (near, far, text): keys of the lines of each text with its host and for any host, hash of all of them."""
    for batch in batches:
        near, far, of = [], [], []
        for host, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = counted(text)
            near += [line_key(host, x) for x in lines]
            far += [line_key(ANYWHERE, x) for x in lines]
            of += [_hash("\n".join(sorted(lines)))] * len(lines)
        yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), pa.array(far, pa.int64()), pa.array(of, pa.int64())], names=["near", "far", "text"])


def judged(known: frozenset | None):
    """(id, host, text) -> (id, content) where there is evidence; with ``known`` only where no content is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("near", pa.int64()), ("far", pa.int64())]))
        for batch in batches:
            keep, content = [], []
            for k, (host, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                e, c = judge(text, host, known)
                if e and (known is None or not c):
                    keep.append(k)
                    content.append([{"near": a, "far": b} for a, b in c])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(content, kind)], names=["id", "content"])

    return run


def boilerplate(rows: DataFrame, scratch: Scratch, min_texts: int, min_hosts: int) -> DataFrame:
    """(key) of every line that at least ``min_texts`` texts of a host hold, or texts of at least ``min_hosts`` hosts."""
    lines = rows.mapInArrow(line_keys, "near bigint, far bigint, text bigint").groupBy("far", "text").agg(F.min("near").alias("near"))  # copies count for one host
    by_host = scratch.write(lines.groupBy("far", "near").agg(F.count("*").alias("n")), "lines")
    many = by_host.groupBy("far").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= min_hosts).select("far")
    own = by_host.filter(F.col("n") >= min_texts).join(many, "far", "left_anti")
    return many.select(F.col("far").alias("key")).unionByName(own.select(F.col("near").alias("key")))


def residue(df: DataFrame, id_col: str, text_col: str, host_col: str, min_texts: int = 5, min_hosts: int = 5) -> DataFrame:
    """(id) of every document without content of its own.

    At most ``MAX_SENT`` keys of boilerplate are sent to the tasks, which then read a text only up to its first content;
    beyond that all lines are judged and their keys joined.
    """
    scratch = Scratch(df.sparkSession, "residue")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("text")).filter(r"text rlike '(?U)\\S'")
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, content array<struct<near: bigint, far: bigint>>"
    known = scratch.write(boilerplate(rows, scratch, min_texts, min_hosts), "boilerplate")
    scratch.drop("lines")
    if known.count() <= MAX_SENT:
        sent = frozenset(known.toArrow().column("key").to_pylist())
        return rows.mapInArrow(judged(sent), shape).select(F.col("id").alias(id_col))
    doubtful = scratch.write(rows.mapInArrow(judged(None), shape).withColumn("row", F.monotonically_increasing_id()), "doubtful")
    lines = doubtful.select("row", F.explode("content").alias("c")).select("row", "c.near", "c.far")
    unknown = lines.join(known.select(F.col("key").alias("near")), "near", "left_anti").join(known.select(F.col("key").alias("far")), "far", "left_anti").select("row")
    return doubtful.join(unknown, "row", "left_anti").select(F.col("id").alias(id_col))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return residue(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
