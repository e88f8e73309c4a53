"""Problem 5: spellings that name one person, organisation or place.

Every name is rewritten canonically: case, accents and punctuation go, abbreviations and nicknames are spelt out, the
order of tokens is ignored, titles and articles are dropped, middle initials and legal forms set aside as qualifiers.
Names of equal base are one candidate entity. Further rewritings (a token with one character left out, for typing
errors; the first name's initial; the other names that a nickname stands for) are exploded into forms and equi-joined.
A link is scored by how rare its form is among entities: the score is the share of the form's mentions, over all
entities that have the form, that one entity holds. A form of one entity scores 1; one that many share in like parts
tells nothing and links none of them; a stray misspelling beside a frequent name takes nothing from it. Two words one
character apart are spellings of one word if a good share of the bases that hold the rarer one occur with the other
word too. Both are shares, so neither depends on how many rows there are.

Qualifiers that contradict each other (two middle initials, two legal forms) keep names apart, and a name without one
then goes with neither. Null, blank and unnameable strings (no letter) are in no pair; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..runtime import stored

# Abbreviations, dropped words, legal forms, words that mark organisations.
_EXPAND = dict(
    x.split("=")
    for x in "univ=university uni=university inst=institute instit=institute lab=laboratory mus=museum acad=academy soc=society assn=association assoc=association ass=association intl=international bros=brothers ltd=limited corp=corporation co=company comp=company inc=incorporated st=saint mt=mount ft=fort pt=port upr=upper lk=lake nth=north sth=south dept=department hosp=hospital lib=library coll=college natl=national govt=government centre=center".split()
)
_DROPPED = set("the of for and a an de la le du des der die das von van el los las y et dr prof mr mrs ms miss sir madam jr sr phd professor doctor rev hon saintly m mme mlle herr frau sra srta don dona".split())
_LEGAL = set("limited company corporation incorporated llc plc gmbh ag sa nv bv oy ab kg ооо оао зао пао ао ип тоо".split())
# Legal forms that Chinese and Japanese names carry without a space, the longest first, and what they are called here.
_LEGAL_HAN = "股份有限公司 有限责任公司 有限公司 株式会社 有限会社 合同会社 集团公司 公司 集团".split()
_TITLES_HAN = "先生 女士 小姐 博士 教授 さん 様 氏".split()
_ORG = set("university institute laboratory museum academy society association international brothers college hospital department library foundation agency bank".split())
_PLACE = set("saint mount fort port upper lower lake north south east west new bay cape isle river".split())
# Nicknames and spelling variants with the names they stand for, the likeliest first.
_NICK_TEXT = """abby=abigail abbie=abigail gail=abigail alex=alexander,alexandra al=albert,alan,alexander andy=andrew drew=andrew annie=anne tony=anthony art=arthur
barb=barbara babs=barbara barbie=barbara becky=rebecca becca=rebecca ben=benjamin benny=benjamin beth=elizabeth betty=elizabeth betsy=elizabeth bess=elizabeth
bill=william billy=william will=william willy=william bob=robert bobby=robert rob=robert robbie=robert bert=albert,robert carrie=caroline cathy=catherine kathy=katherine
kate=katherine katie=katherine kathie=katherine kit=katherine kitty=katherine catherine=katherine kathryn=katherine kat=katherine charlie=charles chuck=charles chas=charles chris=christina,christopher chrissy=christina
tina=christina christine=christina cindy=cynthia dan=daniel danny=daniel dave=david debbie=deborah deb=deborah debby=deborah debra=deborah dick=richard dolly=dorothy dot=dorothy dottie=dorothy
don=donald ed=edward eddie=edward ted=edward,theodore teddy=edward,theodore ned=edward ellie=eleanor nell=eleanor nellie=eleanor nora=eleanor elinor=eleanor eleanore=eleanor lenore=eleanor
liz=elizabeth lizzie=elizabeth lisa=elizabeth elisabeth=elizabeth eliza=elizabeth libby=elizabeth fran=frances,francoise frank=francis fred=frederick freddie=frederick freddy=frederick rick=richard,frederick
gabe=gabriel gab=gabriel gus=august geoff=geoffrey greg=gregory gregg=gregory hal=henry,harold hank=henry harry=henry,harold heddy=hedwig hedy=hedwig jack=john jackie=jacqueline jacquie=jacqueline
jim=james jimmy=james jamie=james jem=james jeff=jeffrey jen=jennifer jenny=jennifer jerry=gerald jo=josephine,joanna joe=joseph joey=joseph jos=joseph josie=josephine jon=jonathan,john johnny=john
josh=joshua ken=kenneth larry=lawrence lars=lawrence laurie=lawrence laurence=lawrence lorenz=lawrence len=leonard lenny=leonard leo=leonard leonhard=leonard maggie=margaret meg=margaret
marge=margaret margie=margaret peggy=margaret greta=margaret madge=margaret margot=margaret mark=marek matt=matthew mathew=matthew matty=matthew mick=michael mike=michael mickey=michael mikey=michael mitch=mitchell
nick=nicholas nicky=nicholas nico=nicholas klaus=nicholas nicolas=nicholas oscar=oskar ozzie=oskar pam=pamela pat=patricia,patrick patty=patricia pattie=patricia trish=patricia tricia=patricia
penny=penelope pen=penelope pete=peter petey=peter phil=philip phillip=philip pip=philip quent=quentin quint=quentin ray=raymond richie=richard rich=richard ricky=richard ron=ronald sam=samuel,samantha
sammy=samuel,samantha sandy=alexander,sandra stan=stanley steve=steven sue=susan susie=susan suzy=susan suzie=susan susanna=susan terry=theresa tess=theresa tessa=theresa tessie=theresa teresa=theresa therese=theresa
thea=theodora tim=timothy timmy=timothy tom=thomas tommy=thomas ursel=ursula uschi=ursula val=valerie vicky=victoria vicki=victoria vic=victor,victoria viktoria=victoria tori=victoria vince=vincent walt=walter
wendy=gwendolyn yvon=yvonne evonne=yvonne xen=xenia zach=zachary zack=zachary zak=zachary zac=zachary zachariah=zachary layla=leila laila=leila nikolas=nicholas niklas=nicholas josef=joseph katharine=katherine katharina=katherine kristina=christina viktor=victor frederik=frederick philipp=philip dorothea=dorothy dora=dorothy dory=dorothy sofie=sophia toby=tobias"""
# Short forms of Russian given names.
_NICK_CYRILLIC = """саша=александр,александра шура=александр,александра алёша=алексей лёша=алексей аня=анна нюра=анна ася=анастасия настя=анастасия боря=борис вадик=вадим валя=валентина,валентин ваня=иван варя=варвара вася=василий
витя=виктор вика=виктория вова=владимир володя=владимир галя=галина гена=геннадий гриша=григорий дима=дмитрий митя=дмитрий женя=евгений,евгения жора=георгий зина=зинаида ира=ирина катя=екатерина костя=константин ксюша=ксения
лара=лариса лена=елена лида=лидия люба=любовь люда=людмила макс=максим маша=мария миша=михаил надя=надежда наташа=наталья наталия=наталья никита=никита оля=ольга паша=павел петя=пётр рома=роман света=светлана сеня=семён
серёжа=сергей слава=вячеслав,станислав соня=софья софия=софья стёпа=степан таня=татьяна тёма=артём толя=анатолий федя=фёдор юра=юрий юля=юлия яша=яков"""
_LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(_LETTERS.get(c, c) for c in text if not unicodedata.combining(c))


_NICK = {plain(k): plain(v).split(",") for k, v in (x.split("=") for x in f"{_NICK_TEXT} {_NICK_CYRILLIC}".split())}
_HAN_NAME = re.compile(r"[一-鿿㐀-䶿ぁ-ヿ々]+")


def _without_form(word: str) -> list[str]:
    """A Chinese or Japanese word with its legal form as a word of its own and without a title."""
    if not _HAN_NAME.fullmatch(word):
        return [word]
    for form in _LEGAL_HAN:
        if word.endswith(form) and len(word) > len(form):
            return [word[: -len(form)], form]
        if word.startswith(form) and len(word) > len(form):
            return [word[len(form) :], form]
    title = next((t for t in _TITLES_HAN if word.endswith(t) and len(word) > len(t) + 1), "")
    return [word[: len(word) - len(title)]]


def parse(name: str) -> dict | None:
    """base, qualifier, org, and what further forms need, of one name; None if it names nothing."""
    words = re.findall(r"[^\W_]+", re.sub(r"['’`´]", "", plain(name)))
    words = [x for w in words for x in _without_form(_EXPAND.get(w, w))]
    kept = [w for w in words if w not in _DROPPED or len(w) == 1]
    if len([w for w in kept if len(w) > 1]) == 0:
        kept = words
    if not kept or not any(c.isalpha() for w in kept for c in w):
        return None
    legal = next((w for w in kept if w in _LEGAL or w in _LEGAL_HAN), None)
    org = bool(legal) or any(w in _ORG for w in kept)
    rest = [w for w in kept if w not in _LEGAL and w not in _LEGAL_HAN] or kept
    long = [w for w in rest if len(w) > 1]
    initials = [w for w in rest if len(w) == 1 and w.isalpha()]
    other: list[str] = []
    if org or not initials:
        base, qualifier, short = sorted(rest), legal, False
    elif len(long) >= 2 and len(words) > len(long) and not (words[0] in initials and "-" in name):
        base, qualifier, short = sorted(long), initials[0], False
    elif long:
        base, qualifier, short = [initials[0], *sorted(long)], initials[1] if len(initials) > 1 else None, True
    else:
        base, qualifier, short = rest, None, False
    if not org and not short and len(base) > 1:
        for i, w in enumerate(base):
            if w in _NICK:
                first, *more = _NICK[w]
                other = [" ".join(sorted([*base[:i], x, *base[i + 1 :]])) for x in more]
                base = sorted([*base[:i], first, *base[i + 1 :]])
                break
    return {"base": " ".join(base), "qualifier": qualifier, "org": org, "short": short, "other": other}


def _parsed(batches):
    """(name, n) to (name, n, base, qualifier, org, short, other)."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p = parse(name)
            if p:
                for part, x in zip(out, (name, n, p["base"], p["qualifier"], p["org"], p["short"], p["other"])):
                    part.append(x)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["name", "n", "base", "qualifier", "org", "short", "other"])


def omissions(base: str) -> list[str]:
    """The base itself and all it becomes when one character of one token of four letters or more is left out."""
    words = base.split(" ")
    out = {base}
    for i, w in enumerate(words):
        if len(w) >= 4 and w not in _PLACE and w not in _ORG:
            others = words[:i] + words[i + 1 :]
            for j in range(len(w)):
                if j == 0 or w[j] != w[j - 1]:
                    out.add(" ".join(sorted([*others, w[:j] + w[j + 1 :]])))
    return sorted(out)


def _omission_rows(batches):
    """(base) to (form, base)."""
    for batch in batches:
        forms, bases = [], []
        for base in batch.column(0).to_pylist():
            f = omissions(base)
            forms += f
            bases += [base] * len(f)
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(bases, pa.string())], names=["form", "base"])


def near(a: str, b: str) -> bool:
    """Whether two strings differ by one inserted, missing, changed or swapped character."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    long, small = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == small[i:]


def difference(a: str, b: str) -> list[str]:
    """The one token of each base that the other lacks, if they are ``near``; else nothing."""
    x, y = a.split(" "), b.split(" ")
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    return [x[0], y[0]] if len(x) == len(y) == 1 and near(x[0], y[0]) and min(len(x[0]), len(y[0])) > 2 else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difference(x, y) for x, y in zip(a, b)])


def mentions(sentences: DataFrame) -> DataFrame:
    """name, n: the distinct strings of entities, heads and tails, with how often each occurs."""
    ends = F.flatten(F.transform(F.coalesce("triples", F.array()), lambda t: F.array(t["head"], t["tail"])))
    return sentences.select(F.explode(F.concat(F.coalesce("entities", F.array()), ends)).alias("name")).filter("name is not null and trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))


#: Least share of the rarer word's bases that have a twin with the commoner word, for the two to be spellings of one word.
TWINS = 0.2


#: Least share of a form's mentions that an entity must hold for the form to link to it.
OWNED = 0.8


def owners(forms: DataFrame, by: str) -> DataFrame:
    """``by``, entity, score: of (by, entity, n) the entity that holds most mentions of each form, if that tells."""
    held = forms.groupBy(by, "entity").agg(F.sum("n").alias("n"))
    best = held.groupBy(by).agg(F.max_by("entity", F.struct("n", "entity")).alias("entity"), (F.max("n") / F.sum("n")).alias("score"))
    return best.filter(F.col("score") >= OWNED)


def entities(names: DataFrame) -> DataFrame:
    """name, base, qualifier, entity for every name: rows of one entity, and of no contradicting qualifier, are one."""
    parsed = stored(names.select("name", "n").mapInArrow(_parsed, "name string, n long, base string, qualifier string, org boolean, short boolean, other array<string>"))
    bases = stored(parsed.groupBy("base").agg(F.max("org").alias("org"), F.min("short").alias("short"), F.sum("n").alias("n")))
    # typing errors
    full = bases.filter("not short").select("base")
    forms = stored(full.mapInArrow(_omission_rows, "form string, base string").select(F.xxhash64("form").alias("form"), "base"))
    met = forms.select("form", F.col("base").alias("a")).join(forms.select("form", F.col("base").alias("b")), "form").filter("a < b").select("a", "b").distinct()
    differ = stored(met.withColumn("d", _difference("a", "b")).filter(F.size("d") > 0).select("a", "b", F.get("d", F.lit(0)).alias("x"), F.get("d", F.lit(1)).alias("y")))
    wanted = differ.select(F.explode(F.array("x", "y")).alias("word")).distinct()
    df = full.select(F.explode(F.array_distinct(F.split("base", " "))).alias("word")).join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    twins = differ.groupBy(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("w")).agg(F.count("*").alias("twins"))
    counted = twins.join(df.select(F.col("word").alias("v"), F.col("df").alias("dv")), "v").join(df.select(F.col("word").alias("w"), F.col("df").alias("dw")), "w")
    one = counted.filter(F.col("twins") >= TWINS * F.least("dv", "dw")).select("v", "w")
    typed = stored(differ.withColumn("v", F.least("x", "y")).withColumn("w", F.greatest("x", "y")).join(one, ["v", "w"], "left_semi").select("a", "b"))
    first = stored(_labels(bases, connected_components(typed)))
    # initials: a form links to the entity that holds it
    few = first.filter("not short and not org and size(split(base, ' ')) between 2 and 3").select("entity", "n", F.split("base", " ").alias("w"))
    forms_of = F.transform("w", lambda x, i: F.concat_ws(" ", F.substring(x, 1, 1), F.array_join(F.filter("w", lambda y, j: j != i), " ")))
    initial = stored(few.select("entity", "n", F.explode(F.array_distinct(forms_of)).alias("form")).groupBy("form", "entity").agg(F.sum("n").alias("n")))
    short = first.filter("short").select("base", F.col("entity").alias("b"))
    known = short.join(initial.select(F.col("form").alias("base")).distinct(), "base", "left_semi").select("base")
    shorts = short.join(owners(initial, "form").withColumnRenamed("form", "base"), "base").select(F.col("entity").alias("a"), "b")
    # a typing error beside an initial: forms that one character left out makes equal
    left = short.join(known, "base", "left_anti")
    slips = left.select("base").mapInArrow(_omission_rows, "form string, base string").select(F.xxhash64("form").alias("h"), F.col("base").alias("x"))
    right = initial.select(F.col("form").alias("base")).distinct().mapInArrow(_omission_rows, "form string, base string").select(F.xxhash64("form").alias("h"), F.col("base").alias("y"))
    near_forms = slips.join(right, "h").select("x", "y").distinct().withColumn("d", _difference("x", "y")).filter((F.size("d") > 0) & (F.length(F.get("d", F.lit(0))) > 4))
    slipped = owners(near_forms.join(initial.withColumnRenamed("form", "y"), "y").select("x", "entity", "n"), "x")
    shorts = shorts.union(slipped.join(left.withColumnRenamed("base", "x"), "x").select(F.col("entity").alias("a"), "b"))
    # nicknames that stand for more than one name
    nick = parsed.filter(F.size("other") > 0).select("base", F.explode("other").alias("read")).distinct()
    read_as = nick.join(first.select(F.col("base").alias("read"), "entity", "n"), "read")
    spelt = parsed.filter((F.size("other") == 0) & ~F.col("short")).select("base").distinct()
    readings = owners(read_as.join(spelt, "base", "left_anti").select("base", "entity", "n"), "base").select("base", F.col("entity").alias("a"))
    readings = readings.join(first.select("base", F.col("entity").alias("b")), "base").select("a", "b")
    second = connected_components(stored(shorts.union(readings)))
    placed = first.join(second.select(F.col("node").alias("entity"), "component"), "entity", "left").select("base", F.coalesce("component", "entity").alias("entity"))
    return stored(parsed.select("name", "base", "qualifier").join(placed, "base"))


def _labels(bases: DataFrame, labels: DataFrame) -> DataFrame:
    return bases.join(labels.select(F.col("node").alias("base"), "component"), "base", "left").select("base", "org", "short", "n", F.coalesce("component", "base").alias("entity"))


def _told_apart(named: DataFrame) -> DataFrame:
    """name, entity with contradicting qualifiers split off: their own entity each, and one for names without."""
    many = named.groupBy("entity").agg((F.min("qualifier") != F.max("qualifier")).alias("split"))
    return named.join(many, "entity").select("name", F.when(F.coalesce("split", F.lit(False)), F.concat_ws("\n", "entity", F.coalesce("qualifier", F.lit("")))).otherwise(F.col("entity")).alias("entity"))


def linked(sentences: DataFrame) -> DataFrame:
    """name, entity, links: every spelling with its entity and the number of other spellings of it."""
    told = stored(_told_apart(entities(mentions(sentences))))
    sizes = told.groupBy("entity").agg(F.count("*").alias("n"), F.min("name").alias("label"))
    return told.join(sizes, "entity").select("name", F.col("label").alias("entity"), (F.col("n") - 1).alias("links"))


def pairs(sentences: DataFrame) -> DataFrame:
    """name_a, name_b: pairs of spellings of one entity, smaller first by code point."""
    told = stored(_told_apart(entities(mentions(sentences))))
    return told.select("entity", F.col("name").alias("name_a")).join(told.select("entity", F.col("name").alias("name_b")), "entity").filter("name_a < name_b").select("name_a", "name_b")
