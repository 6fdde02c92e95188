"""Problem 2: spellings of one person or organisation linked by noisy-channel attribution.

Names are read in one character form (look-alikes and accents folded) as a person (given name, initials, surname) or
an organisation (words without its legal form); two words that may be either are read as both. Equal readings are one
spelling, ranked by a prior from how often it stands and how connected its nodes are; full spellings are the candidate
canonical forms. Spellings that a writer may have meant each other by meet on blocking keys (a given name's initial and
the surname with one letter left out, an organisation with one word left out, joined and initial forms). A key has two
sides, what was typed and what was meant: initials meet full names and not each other, and so on, so that a frequent
surname does not make all its bearers meet. Keys are aggregated to distinct spellings first, so that a name that holds
a third of all rows is one row. For each meeting pair the channel gives the likelihood of the typo, nickname, initial,
abbreviation, drop or reordering.

Every spelling competes with itself: it may mean what it says. A typo is believed only if the word it must have been
stands in so many different names, and its own word in so few others, that the channel outweighs the prior of the word
itself; two frequent surnames one letter apart stay apart. Each spelling is attached to the meaning with the largest
posterior. Attachments form groups.

Defined results: null and empty names, and names that are neither a person's nor an organisation's (with digits,
slashes or underscores), take no part, nor do rows without an id or a scope; a null degree counts as none; repeated ids count once; an empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.forms import table_form
from strataweave.llm.personal import GIVEN
from strataweave.operators.components import components
from strataweave.session import kept

# Short and pet forms, each with the given names it may stand for.
NICKNAMES = {
    short: set(full.split("/"))
    for short, full in (
        x.split("=")
        for x in (
            "will=william bill=william billy=william willy=william rob=robert bob=robert bobby=robert bert=robert/albert beth=elizabeth liz=elizabeth lizzie=elizabeth betty=elizabeth eliza=elizabeth "
            "mat=mathieu/matthias matt=mathieu/matthew matze=matthias mats=matthias thieu=mathieu guigui=guillaume guigue=guillaume lola=dolores loli=dolores peggy=margaret maggie=margaret meg=margaret "
            "jen=jennifer jenny=jennifer jenn=jennifer dan=daniel danny=daniel dani=daniel mike=michael mick=michael micky=michael sam=samuel sammy=samuel vicky=victoria vic=victoria tori=victoria "
            "sue=susan susie=susan suzy=susan becky=rebecca becca=rebecca kate=katherine kathy=katherine katie=katherine kathi=katharina kati=katharina käthe=katharina pat=patricia patty=patricia trish=patricia tricia=patricia "
            "greg=gregory tom=thomas/tomas tommy=thomas tomasito=tomas ed=edward ted=edward eddie=edward ned=edward basti=sebastian seb=sebastian bastian=sebastian tiao=sebastiao hannes=johannes hans=johannes jo=johannes "
            "memo=guillermo guille=guillermo willi=guillermo pepe=jose chepe=jose paco=francisco fran=francisco pancho=francisco curro=francisco lucy=lucia luci=lucia nacho=ignacio iñaki=ignacio "
            "pili=pilar merche=mercedes meche=mercedes moncho=ramon mon=ramon tonio=antonio toninho=antonio toni=antonio to=antonio bia=beatriz bea=beatriz triz=beatriz nanda=fernanda fe=fernanda edu=eduardo dudu=eduardo "
            "fred=frederic frede=frederic fredo=frederic titi=thibault thib=thibault zaz=zoe lolo=laurent ben=benoit benji=benoit lena=helene nene=helene elo=elodie lodie=elodie didi=elodie margo=margaux margot=margaux "
            "sol=solene soso=solene juergen=jurgen guenther=gunther gunni=gunther rike=friederike friedel=friederike fritzi=friederike wolf=wolfgang wolfi=wolfgang anne=anneliese liese=anneliese anni=anneliese lilo=anneliese "
            "maruja=maria mari=maria mariquita=maria andy=andres ro=rocio chio=rocio ine=ines nines=ines ollie=oliver olly=oliver oli=oliver noor=nora norah=nora con=conceicao sao=conceicao ceicao=conceicao "
            "ger=rogerio geo=rogerio roger=rogerio lu=luisa luisinha=luisa taninha=tania joaozinho=joao jonny=joao uta=ute jack=john johnny=john pete=peter"
        ).split()
    )
}
LEGAL = re.compile(r"(?:[,\s]+(?:group plc|plc|ltd|limited|inc|incorporated|llc|llp|gmbh|ag|s\.? ?l|s\.? ?a|corp|corporation|co|company|bv|oy|ab|sarl|lda)\.?)+$")
NEW_WORD = 0.02
"""Prior of a word that stands in no other name, counted in names: how often a name is both new and nearly another's."""
FULL = r"^([ox]\||p\|[^|]{2,}\|)"  # readings that a spelling can be attached to
TITLE = re.compile(r"^(?:(?:dr|dra|ms|mr|mrs|miss|prof|sr|sra|herr|frau|monsieur|madame|mme|senhor|senhora)\.? )+")
LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The text without look-alikes, invisible characters and accents; case stays."""
    return "".join(c for c in unicodedata.normalize("NFD", table_form(text)) if not unicodedata.combining(c))


_KNOWN = {fold(g) for g in GIVEN} | {fold(n) for n in NICKNAMES}
_NICK = {fold(k): v for k, v in NICKNAMES.items()}


def one_edit(a: str, b: str) -> bool:
    """Whether the strings are one insertion, deletion, substitution or neighbour swap apart (or equal)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


class Known(set):
    """Given names, found by one-edit spellings through the forms with one letter left out."""

    def __init__(self, names: set[str]) -> None:
        super().__init__(names)
        self.less: dict[str, list[str]] = {}
        for name in names:
            for k in _less(name):
                self.less.setdefault(k, []).append(name)

    def near(self, word: str) -> bool:
        return any(one_edit(word, g) for k in _less(word) for g in self.less.get(k, ()))


def _near_known(word: str, known: set[str]) -> bool:
    if word in known or len(word) < 3:
        return word in known
    return known.near(word) if isinstance(known, Known) else any(one_edit(word, g) for g in known if abs(len(g) - len(word)) < 2)


def parse(name: str, known: set[str]) -> list[str]:
    """Readings of a name: `p|given|initials|surname`, `u|joined`, `o|word word word` or, for a person or an organisation of two words, `x|word word`; none for other things."""
    raw = fold(name).strip()
    if not raw or re.search(r"[\d/_@\\]", raw):
        return []
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", raw) if " " not in raw else raw
    low = TITLE.sub("", spaced.lower()).strip()
    comma = low.count(",") == 1 and not LEGAL.search(low)
    order = low
    if comma:
        last, first = (x.strip() for x in low.split(","))
        order = f"{first} {last}"
    cased = TITLE.sub("", spaced, count=1) if TITLE.match(spaced) else spaced
    words = [w for w in re.split(r"[ .]+", order) if w]
    # a run of capitals before the surname is initials
    if len(words) == 2 and len(words[0]) == 2 and words[0] not in known and re.match(rf"(?:\S+ )*{re.escape(words[0].upper())}\b", cased):
        words = [words[0][0], words[0][1], words[1]]
    plain = [w for w in words if LETTERS.fullmatch(w.replace("-", "").replace("'", ""))]
    full = [w for w in plain if len(w) > 1]
    marks = [w for w in plain if len(w) == 1]
    if len(plain) == len(words) and len(full) == 2 and len(marks) <= 2 and not LEGAL.search(low):
        a, b = full
        if _near_known(a.split("-")[0], known) and not (b in known and a not in known):
            return [f"p|{a}|{''.join(marks)}|{b}"]
        if not comma and _near_known(b, known):
            return [f"p|{b}|{''.join(marks)}|{a}"]
        if comma:
            return [f"p|{a}|{''.join(marks)}|{b}"]
        if marks:
            return [f"p|{a}|{''.join(marks)}|{b}"]
    if len(plain) == len(words) and len(full) == 1 and 1 <= len(marks) <= 2 and len(full[0]) > 3:
        return [f"p|{marks[0]}|{''.join(marks[1:])}|{full[0]}"]
    base = re.sub(r"^the ", "", LEGAL.sub("", low).strip())
    tokens = LETTERS.findall(base.replace(".", "") if re.fullmatch(r"(?:[a-z]\.){2,}[a-z]?", base) else base)
    if comma and "," in base:
        last, first = (LETTERS.findall(x) for x in base.split(",", 1))
        tokens = first + last
    if len(tokens) >= 3:
        return ["o|" + " ".join(tokens)]
    if len(tokens) == 1 and (raw == raw.lower() or len(tokens[0]) > 6):
        return ["u|" + tokens[0]]
    if len(tokens) == 1 and 2 < len(tokens[0]) <= 6:
        return ["a|" + tokens[0]]
    return ["x|" + " ".join(tokens)] if len(tokens) == 2 else []


def _less(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _two(a: str, b: str) -> set[str]:
    """Keys of two words, in any order, with one letter of one of them left out."""
    return {"w:" + " ".join(sorted((k, b))) for k in _less(a)} | {"w:" + " ".join(sorted((a, k))) for k in _less(b)}


def _initials(given: str) -> set[str]:
    """First letters of the names that a given name may stand for."""
    return {given[0]} | {full[0] for full in _NICK.get(given, ())}


def keys(form: str, role: str = "") -> set[str]:
    """Blocking keys of a spelling as it was typed (role `typed`) or meant (`meant`), both if no role is given.

    If the channel can turn c into v, keys(v, "typed") and keys(c, "meant") have one in common.
    """
    kind, *rest = form.split("|")
    both, typed, meant = set(), set(), set()
    if kind == "p":
        given, _, surname = rest
        parts = {surname, surname.split("-")[0]}
        if len(given) > 1:
            both = {f"s:{i} {k}" for part in parts for k in _less(part) for i in _initials(given)}
            both |= {"w:" + " ".join(sorted((k, part))) for part in parts for k in (given, given[1:], given[0] + given[2:])}  # the initial itself may be mistyped
            meant = {f"u:{k}" for k in _less(given[0] + surname) | _less(given + surname)} | {f"i:{given[0]} {k}" for part in parts for k in _less(part)}
        else:
            typed = {f"i:{given} {k}" for part in parts for k in _less(part)}
    elif kind == "x":
        a, b = rest[0].split()
        both = _two(a, b) | {f"h:{b} {a[:3]}", f"h:{a} {b[:3]}"} | {f"s:{i} {k}" for i in _initials(a) for k in _less(b)} | {f"s:{i} {k}" for i in _initials(b) for k in _less(a)} | {f"j:{a}{b}"}
        meant = {f"u:{k}" for k in _less(a[0] + b) | _less(a + b)} | {f"a:{a[0]}{b[0]}"} | {f"i:{a[0]} {k}" for k in _less(b)}
    elif kind == "u":
        typed = {f"u:{k}" for k in _less(rest[0])}
    elif kind == "a":
        typed = {f"a:{rest[0]}"}
    elif kind == "o":
        words = rest[0].split()
        both = {"w:" + " ".join(sorted(words[:i] + words[i + 1 :])) for i in range(len(words))} | {"w:" + " ".join(sorted(words)), "j:" + "".join(words)}
        meant = {f"u:{k}" for k in _less("".join(words))} | {"a:" + "".join(w[0] for w in words)}
    return both | (typed if role != "meant" else set()) | (meant if role != "typed" else set())


def _readings(form: str, other: str) -> list[str]:
    """What the form may stand for: two words are an organisation, a person or, beside a full name, one whose surname stands first."""
    if not form.startswith("x|"):
        return [form]
    a, b = form[2:].split()
    if min(len(a), len(b)) < 2:
        return [f"o|{a} {b}"]
    swapped = other.startswith("p|") and len(other.split("|")[1]) > 1
    return [f"o|{a} {b}", f"p|{a}||{b}"] + [f"p|{b}||{a}"] * swapped


TYPO = -2.5


def channel(variant: str, canonical: str) -> float | None:
    """Log likelihood that a writer who means `canonical` types `variant`; null when the channel does not allow it."""
    return explain(variant, canonical)[0]


def explain(variant: str, canonical: str) -> tuple[float | None, str | None, str | None]:
    """The likelihood, and, where it takes a typo, the word as typed and as meant."""
    ways = [_likelihood(v, c) for v in _readings(variant, canonical) for c in _readings(canonical, variant)]
    return max((w for w in ways if w is not None), key=lambda w: w[0], default=(None, None, None))


def _likelihood(variant: str, canonical: str) -> tuple[float, str | None, str | None] | None:
    vk, *v = variant.split("|")
    ck, *c = canonical.split("|")
    plain = lambda cost: (cost, None, None)
    if ck == "p" and len(c[0]) > 1:
        given, marks, surname = c
        if vk == "u":
            forms = (given[0] + surname, given + surname)
            return plain(-1.5) if v[0] in forms else plain(-4.0) if any(one_edit(v[0], f) for f in forms) else None
        if vk != "p":
            return None
        g, m, s = v
        cost, typed, meant = 0.0, None, None
        if g == given:
            pass
        elif len(g) == 1:
            if g != given[0]:
                return None
            cost = -1.2
        elif given in _NICK.get(g, ()) or _NICK.get(g, {1}) & _NICK.get(given, {2}):
            cost = -1.0
        elif one_edit(g, given) and len(g) > 2 and len(given) > 3:
            cost, typed, meant = TYPO, g, given
        else:
            return None
        if m and marks and not (m.startswith(marks) or marks.startswith(m)):
            return None
        if s == surname:
            pass
        elif s.split("-")[0] == surname or surname.split("-")[0] == s:
            cost -= 1.5
        elif one_edit(s, surname) and len(s) > 4:
            cost, typed, meant = cost + TYPO, s, surname
        else:
            return None
        return (cost, typed, meant) if cost > -4.6 else None
    if ck == "o":
        words = c[0].split()
        if vk == "a":
            return plain(-2.0) if v[0] == "".join(w[0] for w in words) else None
        if vk == "u":
            return plain(-0.5) if v[0] == "".join(words) else plain(-3.0) if one_edit(v[0], "".join(words)) else None
        if vk != "o":
            return None
        mine = v[0].split()
        if sorted(mine) == sorted(words):
            return plain(-0.2)
        left, right = list(mine), list(words)
        for w in mine:
            if w in right:
                left.remove(w)
                right.remove(w)
        if not left and len(right) == 1 and mine == words[:-1]:
            return plain(-1.5)
        if len(left) == len(right) == 1:
            if len(left[0]) >= 3 and right[0].startswith(left[0]):
                return plain(-1.5)
            if one_edit(left[0], right[0]) and len(right[0]) > 3:
                return TYPO, left[0], right[0]
        if len(left) <= 2 and "".join(mine) == "".join(words):
            return plain(-1.0)
    return None


def _read(known: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Known(_KNOWN | set(known))
        seen: dict[str, list[str]] = {}
        for b in batches:
            rows = []
            for scope, id_, name, degree in zip(b["scope"], b["id"], b["name"], b["degree"]):
                if name not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[name] = parse(name, names)
                rows += [(scope, id_, form, math.log1p(max(0, degree))) for form in seen[name]]
            yield pd.DataFrame(rows, columns=["scope", "id", "form", "weight"])

    return run


def _keyed(role: str):
    def run(forms: pd.Series) -> pd.Series:
        return forms.map(lambda f: sorted(keys(f, role)))

    return F.pandas_udf(run, "array<string>")


def _explained(variant: pd.Series, canonical: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([explain(v, c) for v, c in zip(variant, canonical)], columns=["like", "typed", "meant"]).astype({"like": "float64", "typed": object, "meant": object})


def _contexts(forms: pd.Series) -> pd.Series:
    """Each full word of a spelling with what stands beside it: the initials of the other words."""
    out = []
    for f in forms:
        kind, *rest = f.split("|")
        words = [w for part in rest for w in part.split()] if kind in "pxo" else []
        out.append([(w, "".join(sorted(o[0] for o in words[:i] + words[i + 1 :]))) for i, w in enumerate(words) if len(w) > 1])
    return pd.Series(out)


def spellings(df: DataFrame, scope: str, id_: str, name: str, degree: str, known: list[str]) -> DataFrame:
    """Rows (scope, id, form, weight): the reading of every name that has one."""
    rows = df.where(F.col(name).isNotNull() & F.col(id_).isNotNull() & F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), F.col(id_).alias("id"), F.col(name).alias("name"), F.coalesce(F.col(degree).cast("long"), F.lit(0)).alias("degree"))
    return rows.mapInPandas(_read(tuple(fold(k) for k in known)), "scope long, id long, form string, weight double")


def distinct_spellings(read: DataFrame) -> DataFrame:
    """Rows (scope, form, n, w, node): each spelling of a scope once, named by the smallest id that has it."""
    return read.groupBy("scope", "form").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("id").alias("node"))


def supports(forms: DataFrame) -> DataFrame:
    """Rows (word, d): in how many different names, told apart by scope and initials, a word stands."""
    contexts = F.pandas_udf(_contexts, "array<struct<word:string,beside:string>>")
    return forms.select("scope", F.inline(contexts("form"))).distinct().groupBy("word").agg(F.count("*").alias("d"))


def attach(forms: DataFrame) -> DataFrame:
    """Rows (scope, variant, canonical, posterior, node, root): the spellings that mean another one, with that one."""
    likelihood = F.pandas_udf(_explained, "like double, typed string, meant string")
    can = F.col("form").rlike(FULL)
    c = forms.where(can).select("scope", F.explode(_keyed("meant")("form")).alias("key"), F.col("form").alias("canonical"), F.col("node").alias("root"), F.col("n").alias("cn"), F.col("w").alias("cw"))
    v = forms.select("scope", F.explode(_keyed("typed")("form")).alias("key"), F.col("form").alias("variant"), "node")
    met = v.join(c.hint("merge"), ["scope", "key"]).where(F.col("variant") != F.col("canonical")).drop("key").dropDuplicates(["scope", "variant", "canonical"])
    scored = kept(met.select("*", likelihood("variant", "canonical").alias("x")).select("*", "x.*").drop("x").where(F.col("like").isNotNull()))
    # A typo competes with the word that was typed: how many other names hold it, against how many hold the word that was meant.
    words = supports(forms)
    of = lambda name, d: words.select(F.col("word").alias(name), F.col("d").alias(d)).hint("merge")
    typos = scored.where(F.col("typed").isNotNull()).join(of("typed", "dv"), "typed", "left").join(of("meant", "dc"), "meant", "left")
    itself = F.log(F.greatest(F.coalesce("dv", F.lit(1)) - 1, F.lit(0)) + NEW_WORD)
    believed = typos.where(F.log(F.coalesce("dc", F.lit(1))) + TYPO > itself)
    columns = ["scope", "variant", "canonical", "node", "root", "cn", "cw", "like"]
    scored = scored.where(F.col("typed").isNull()).select(*columns).unionByName(believed.select(*columns))
    posterior = F.col("like") + F.log(F.col("cn")) + 0.05 * F.col("cw")
    best = scored.withColumn("posterior", posterior).groupBy("scope", "variant", "node").agg(F.max_by(F.struct("canonical", "root", "posterior"), F.struct("posterior", "canonical")).alias("b"))
    return best.select("scope", "variant", "node", "b.*")


def groups(df: DataFrame, scope: str, id_: str, name: str, degree: str, known: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Rows (id, root): the group of every id whose name can be read, named by an id of the group.

    `extra` may hold further known links (a, b) between ids of one scope.
    """
    read = kept(spellings(df, scope, id_, name, degree, known).dropDuplicates(["id"]))
    forms = kept(distinct_spellings(read))
    # Members are named by their spelling: copies of one name never meet before the result.
    members = read.join(forms.select("scope", "form", "node").hint("merge"), ["scope", "form"]).select("id", "node")
    links = attach(forms).select(F.col("node").alias("a"), F.col("root").alias("b"))
    if extra is not None:
        ends = extra.join(members.select(F.col("id").alias("a"), F.col("node").alias("na")), "a").join(members.select(F.col("id").alias("b"), F.col("node").alias("nb")), "b")
        links = links.unionByName(ends.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    return members.join(components(links, "a", "b").hint("merge"), "node", "left").select("id", F.coalesce("root", "node").alias("root"))


def same_entity(df: DataFrame, scope: str, id_: str, name: str, degree: str, known: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of one scope whose names stand for the same person or organisation."""
    grouped = kept(groups(df, scope, id_, name, degree, known, extra))
    many = grouped.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("root")
    grouped = grouped.join(many, "root", "left_semi")
    other = grouped.select(F.col("id").alias("id_2"), "root")
    return grouped.join(other.hint("merge"), "root").where(F.col("id") < F.col("id_2")).select(F.col("id").alias("id_a"), F.col("id_2").alias("id_b"))
