"""Variant spellings of names attached to the entity they mean, by a noisy channel.

Candidate canonical forms are the names of a register, and every spelling may
also be a canonical form of its own (a party outside the register). How a
canonical form turns into a spelling is scored word by word: typing slips,
abbreviations, initials, nicknames, dropped and added words, changed order,
acronyms. With the frequency of each canonical form in the corpus as prior,
a spelling goes to the form of maximum posterior, or to none.

Spellings are brought to one character form first, then each distinct
(type, name, aliases) is scored once. Candidates are found without loss: which
words of a name have any word of the spelling to come from gives a floor of
the name's cost, and every name whose floor is within the limit is scored.

Short forms of given names come from a general list and from the corpus: a
word that stands in for one given name before otherwise equal names of
several people is a short form of it.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.normalize import normalize_columns
from strandline.operators.skew import lookup_join
from strandline.session import cut

#: Usual English short forms of given names; those of a corpus are learned beside them.
NICKNAMES = {
    "albert": "al bert bertie", "alexander": "alec alex sandy", "alfred": "alf alfie fred", "andrew": "andy drew", "anthony": "tony", "arthur": "art artie", "barbara": "babs barb",
    "benjamin": "ben benny", "catherine": "cate cathy kate", "charles": "charlie chuck", "christine": "chris chrissie tina", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie", "donald": "don donny", "dorothy": "dolly dora dot dottie", "edward": "ed eddie ned ted teddy", "eleanor": "ella nell nellie nora", "elizabeth": "bess beth betsy betty eliza libby lisa liz lizzie",
    "frances": "fanny fran", "francis": "frank", "frederick": "fred freddie freddy", "gerald": "gerry jerry", "gregory": "greg", "harold": "hal harry", "henry": "hal hank harry", "isabella": "bella izzy", "jacob": "jack jake",
    "james": "jamie jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate kathy katie kitty", "kenneth": "ken kenny",
    "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie marge meg peg peggy", "martha": "marty patty", "mary": "molly polly", "matthew": "matt", "michael": "mick mike", "nathaniel": "nat nate",
    "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "paddy pat", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becca becky", "richard": "dick rich richie rick",
    "robert": "bob bobby rob robbie", "ronald": "ron ronnie", "samuel": "sam sammy", "sarah": "sadie sally", "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy theo", "theresa": "terry tess",
    "thomas": "tom tommy", "timothy": "tim", "victoria": "tori vicky", "vincent": "vin vince vinny", "walter": "wally walt", "william": "bill billy liam will willie",
}
#: A short form is learned if chance would give any word of the register so many names to stand in for less often than this.
CHANCE = 0.01
#: Words before or after a person's name, and words an organisation's name may do without.
TITLES = frozenset("mr mrs ms miss dr prof sir madam the jr sr".split())
FORMS = {"limited": "limited", "ltd": "limited", "plc": "plc", "group": "group", "grp": "group", "co": "company", "company": "company", "asia": "asia", "inc": "inc", "llc": "llc"}
LEGAL = frozenset(("limited", "plc", "inc", "llc"))
DROPPABLE = frozenset(("limited", "plc", "group", "asia", "inc", "llc", "co"))
SMALL = frozenset("of and the for".split())

#: Costs, in nats, of what happens to a name on its way to a spelling.
COST = {"exact": 0.0, "form": 0.1, "abbreviation": 1.0, "nickname": 1.0, "initial": 1.5, "slip": 2.5, "short_slip": 3.5, "two_slips": 5.0, "joined": 0.4, "turned": 0.3, "reordered": 1.2, "reordered_person": 3.0, "acronym": 2.0, "head": 2.0}
CAP = 8.0  # a name that says nothing
LIMIT = 5.5  # dearest way to a spelling that still means an entity, for a name and for each alias
MARGIN = 0.7
PRIOR_WEIGHT = 0.3


def fold(text: str) -> str:
    """Lower case without accents, apostrophes or invisible characters."""
    text = ud.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not ud.combining(c) and ud.category(c) != "Cf")
    return text.replace("ß", "ss").replace("&", " and ").replace("ø", "o").replace("ł", "l")


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    text = fold(text)
    text = re.sub(r"(?<=\w)['’](?=s\b)", "", text)
    return _WORD.findall(text)


@lru_cache(maxsize=200_000)
def slips(a: str, b: str, limit: int = 2) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two words, ``limit`` + 1 if more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (ca != cb))
            if before is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1]


def is_abbreviation(short: str, word: str) -> bool:
    """``short`` begins like ``word`` and its letters follow in order, as in mgmt or corp."""
    if not 2 <= len(short) < len(word) or short[0] != word[0] or short in FORMS:
        return False
    if word.startswith(short):
        return True
    rest = iter(word)
    return len(short) >= 3 and all(c in rest for c in short) and (sum(c in "aeiou" for c in short[1:]) == 0 or short[-1] == word[-1])


class Words:
    """How a word of a name may have been written: costs of pairs of words, remembered. ``shorts``: short forms of each given name."""

    def __init__(self, shorts: dict[str, frozenset[str]]):
        self.shorts = shorts
        self.known: dict[tuple[str, str, bool], float] = {}

    def relation(self, seen: str, word: str, person: bool) -> float:
        """Cost of writing ``word`` as ``seen``; inf where they have nothing in common."""
        at = (seen, word, person)
        cost = self.known.get(at)
        if cost is None:
            if len(self.known) > 500_000:
                self.known.clear()
            cost = self.known[at] = self._relation(seen, word, person)
        return cost

    def _relation(self, seen: str, word: str, person: bool) -> float:
        if seen == word:
            return 0.0
        if not person and FORMS.get(seen, seen) == FORMS.get(word, word):
            return COST["form"]
        if person and len(seen) == 1 and word[0] == seen:
            return COST["initial"]
        if person and (seen in self.of(word) or word in self.of(seen) or (len(seen) >= 3 and word.startswith(seen) and len(word) - len(seen) >= 2)):
            return COST["nickname"]
        if not person and is_abbreviation(seen, word):
            return COST["abbreviation"]
        if min(len(seen), len(word)) >= 3:
            d = slips(seen, word)
            if d == 1:
                return COST["slip"] if len(word) >= 4 else COST["short_slip"]
            if d == 2 and min(len(seen), len(word)) >= 7:
                return COST["two_slips"]
        return math.inf

    def of(self, word: str) -> frozenset[str]:
        return self.shorts.get(word, frozenset())


def _order_cost(order: list[int], person: bool) -> float:
    if order == sorted(order):
        return 0.0
    k = min(range(len(order)), key=order.__getitem__)
    return COST["turned"] if order[k:] + order[:k] == sorted(order) else COST["reordered_person" if person else "reordered"]


def channel(seen: list[str], name: list[str], person: bool, words_: Words) -> float:
    """Cost of the register name (as words) having become the words seen."""
    if not seen:
        return CAP
    if not person:
        content = [w for w in name if w not in SMALL]
        core = [w for w in content if w not in DROPPABLE]
        if len(seen) == 1 and len(seen[0]) >= 2:
            for letters in (content, core, [w for w in name]):
                if len(letters) >= 2 and seen[0] == "".join(w[0] for w in letters):
                    return COST["acronym"]
    edges = sorted((c, j, i) for i, s in enumerate(seen) for j, w in enumerate(name) if (c := words_.relation(s, w, person)) < math.inf)
    by_seen: dict[int, int] = {}
    by_name: dict[int, int] = {}
    cost = 0.0
    for c, j, i in edges:
        if i not in by_seen and j not in by_name:
            by_seen[i], by_name[j] = j, i
            cost += c
    # Two words of the name written as one, or one as two.
    for i, s in enumerate(seen):
        if i in by_seen:
            continue
        for j in range(len(name) - 1):
            if j in by_name or j + 1 in by_name:
                continue
            both = name[j] + name[j + 1]
            d = 0 if s == both else slips(s, both, 1) if len(s) >= 5 else 2
            if d <= 1:
                by_seen[i] = j
                by_name[j] = by_name[j + 1] = i
                cost += COST["joined"] + d * COST["slip"]
                break
    for j, w in enumerate(name):
        if j in by_name:
            continue
        for i in range(len(seen) - 1):
            if i not in by_seen and i + 1 not in by_seen and seen[i] + seen[i + 1] == w:
                by_seen[i] = by_seen[i + 1] = j
                by_name[j] = i
                cost += COST["joined"]
                break
    missing = [w for j, w in enumerate(name) if j not in by_name]
    extra = [s for i, s in enumerate(seen) if i not in by_seen]
    if person:
        western = len(name) == 3 and 1 not in by_name and 0 in by_name and 2 in by_name
        cost += sum(1.5 if western else CAP for w in missing)
        cost += sum(0.2 if s in TITLES else 0.5 if any(s in words_.of(w) for w in name) else 3.0 for s in extra)
        # Someone must be named by more than initials and short forms alone.
        if not any(len(seen[i]) > 1 and words_.relation(seen[i], name[j], True) != COST["nickname"] for i, j in by_seen.items()):
            cost += 4.0
    else:
        core = [j for j, w in enumerate(name) if w not in DROPPABLE and w not in SMALL]
        lost = [j for j in core if j not in by_name]
        headed = len(core) - len(lost) >= 2 and core[len(core) - len(lost) :] == lost
        cost += sum(0.4 if w in DROPPABLE else 0.2 if w in SMALL else 0.0 for w in missing)
        cost += (COST["head"] if headed else 4.0 * len(lost)) if lost else 0.0
        clash = any(s in LEGAL or FORMS.get(s) in LEGAL for s in extra) and any(w in LEGAL for w in missing)
        cost += sum(0.2 if s in TITLES or s in SMALL else 0.5 if s == "co" or FORMS.get(s) in LEGAL else 4.0 for s in extra) + (3.0 if clash else 0.0)
    order = [by_seen[i] for i in sorted(by_seen)]
    return min(CAP, cost + _order_cost(order, person))


def _deletes(word: str, most: int = 1) -> set[str]:
    """The word without up to ``most`` of its letters: two words within as many slips share one of these."""
    out = {word}
    for _ in range(most if len(word) >= 3 else 0):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


class Register:
    """The canonical names of one register with the indexes that find candidates. Rows: entity, type, name, count in the corpus."""

    def __init__(self, rows: Iterable[tuple[int, str, str, int]], shorts: dict[str, frozenset[str]]):
        self.words = Words(shorts)
        self.names: list[tuple[int, list[str], bool, float]] = []
        self.places: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)  # (type, word) -> names and positions
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)  # two words written as one
        self.letters: dict[tuple[str, str], set[int]] = defaultdict(set)  # acronyms
        self.near: dict[tuple[str, str], set[str]] = defaultdict(set)  # words by a key that related words share
        self.found: dict[tuple[str, str], list[tuple[str, float]]] = {}
        for entity, kind, name, count in rows:
            ws, person, n = words(name), kind == "person", len(self.names)
            self.names.append((entity, ws, person, PRIOR_WEIGHT * math.log1p(count)))
            for j, w in enumerate(ws):
                self.places[kind, w].append((n, j))
                for k in self._keys(w, person):
                    self.near[kind, k].add(w)
                for short in shorts.get(w, ()):
                    self.near[kind, short].add(w)
            for j, (a, b) in enumerate(zip(ws, ws[1:])):
                for k in _deletes(a + b):
                    self.pairs[kind, k].append((n, j))
            if not person:
                content = [w for w in ws if w not in SMALL]
                for part in (ws, content, [w for w in content if w not in DROPPABLE]):
                    if len(part) > 1:
                        self.letters[kind, "".join(w[0] for w in part)].add(n)

    def _keys(self, word: str, person: bool) -> set[str]:
        """Keys of which a word shares one with every word it is related to (but for short forms)."""
        keys = _deletes(word, 2 if len(word) >= 7 else 1)
        keys.add("=" + FORMS.get(word, word))
        keys.add("^" + word[0])
        return keys

    def related(self, kind: str, seen: str) -> list[tuple[str, float]]:
        """All words of the register that ``seen`` may be written for, with the cost."""
        at = (kind, seen)
        if at not in self.found:
            if len(self.found) > 200_000:
                self.found.clear()
            person = kind == "person"
            near: set[str] = set()
            for k in self._keys(seen, person) | self.words.of(seen):
                near |= self.near.get((kind, k), set())
            self.found[at] = [(w, c) for w in near if (c := self.words.relation(seen, w, person)) < math.inf]
        return self.found[at]

    def candidates(self, kind: str, seen: list[str]) -> set[int]:
        """Every name that can have become the words seen at a cost of at most ``LIMIT``."""
        if not seen:
            return set()
        ways: dict[int, dict[int, float]] = defaultdict(dict)
        for s in set(seen):
            for w, c in self.related(kind, s):
                for n, j in self.places[kind, w]:
                    if c < ways[n].get(j, math.inf):
                        ways[n][j] = c
            for k in _deletes(s):
                for n, j in self.pairs.get((kind, k), ()):
                    ways[n][j] = ways[n][j + 1] = 0.0
        for a, b in zip(seen, seen[1:]):
            for n, j in self.places.get((kind, a + b), ()):
                ways[n][j] = 0.0
        out = {n for n, costs in ways.items() if self._floor(n, costs) <= LIMIT}
        return out | self.letters.get((kind, seen[0]), set()) if len(seen) == 1 else out

    def _floor(self, n: int, costs: dict[int, float]) -> float:
        """No less than this does it cost, each word coming from its cheapest source or being lost, whichever is less."""
        _, name, person, _ = self.names[n]
        if person:
            return sum(min(costs.get(j, CAP), 1.5 if j == 1 and len(name) == 3 else CAP) for j in range(len(name)))
        core = [costs.get(j, math.inf) for j, w in enumerate(name) if w not in DROPPABLE and w not in SMALL]
        heads = [sum(core[:k]) + COST["head"] for k in range(2, len(core))]
        return min([sum(min(c, 4.0) for c in core), *heads])

    def attach(self, kind: str, name: str, aliases: list[str], count: int) -> int | None:
        """The entity of maximum posterior, or None."""
        forms = [words(name)] + [w for a in aliases if a and (w := words(a))]
        found: set[int] = set()
        for f in forms:  # within the limit over all forms, a name is so for one of them
            found |= self.candidates(kind, f)
        return self.best(forms, found, count)

    def best(self, forms: list[list[str]], found: Iterable[int], count: int) -> int | None:
        scored = []
        for n in found:
            entity, ws, person, prior = self.names[n]
            cost = sum(min(channel(f, ws, person, self.words), LIMIT if i else CAP) for i, f in enumerate(forms))
            if cost <= LIMIT * len(forms):
                scored.append((prior - cost, entity))
        scored.sort(reverse=True)
        if not scored:
            return None
        best, entity = scored[0]
        itself = PRIOR_WEIGHT * math.log1p(count) - LIMIT * len(forms)
        if best <= itself or (len(scored) > 1 and best - scored[1][0] < MARGIN):
            return None
        return entity


def _rests(ws: list[str]) -> list[tuple[str, str]]:
    """(the other words in order, word) for every word of a person's name."""
    return [(" ".join(sorted(ws[:i] + ws[i + 1 :])), w) for i, w in enumerate(ws)]


def short_forms(spelled: DataFrame, persons: list[str]) -> dict[str, frozenset[str]]:
    """Short forms of each given name: the general list, and what the corpus shows.

    A word that no name of the register holds, and that stands where the other
    words are those of names, may be a short form of the word it replaces, if
    that is a given name (the first word), it is shorter, begins with the same
    two letters and is no slip of it. The more often that word is among the
    replaced ones, against its part of the register, the surer: the Chernoff
    bound of so many by chance, for any word, must be below ``CHANCE``. All
    spellings are counted, on the map side; pairs that pass reach the driver,
    which are fewer than the pairs of a word and a name of the register.
    """
    spark = spelled.sparkSession
    listed = {w for p in persons for w in words(p)}
    # A name's other words, and without its middle one.
    named = sorted({(rest, ws[0]) for ws in map(words, persons) if len(ws) > 1 for rest in ({" ".join(sorted(ws[1:]))} | ({ws[2]} if len(ws) == 3 else set()))})
    out: dict[str, set[str]] = {w: set(n.split()) for w, n in NICKNAMES.items()}
    if not named:
        return {w: frozenset(n) for w, n in out.items()}
    rests = len({rest for rest, _ in named})
    usual = Counter(w for _, w in named)
    listed_words = spark.sparkContext.broadcast(listed)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = {(rest, w) for name in part["name"] for rest, w in _rests(words(name)) if rest and len(w) > 1 and w not in listed_words.value and w not in TITLES}
            yield pd.DataFrame(sorted(rows), columns=["rest", "short"])

    seen = spelled.where(F.col("type") == "person").select("name").mapInPandas(run, "rest string, short string").distinct()
    known = F.broadcast(spark.createDataFrame([(rest, w, usual[w] / rests) for rest, w in named], "rest string, word string, part double"))  # as bounded as the register
    places = seen.join(F.broadcast(known.select("rest").distinct()), "rest", "left_semi").groupBy("short").agg(F.count(F.lit(1)).alias("of"))
    pairs = seen.join(known, "rest").groupBy("short", "word", "part").agg(F.count(F.lit(1)).alias("n")).join(places, "short")
    share = F.col("n") / F.col("of")
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - F.col("part")))).otherwise(F.lit(0.0))
    alike = (F.substring("short", 1, 2) == F.substring("word", 1, 2)) & (F.length("short") < F.length("word"))
    kept = pairs.where(alike & (share > F.col("part")) & (F.lit(len(usual)) * F.exp(-F.col("of") * (share * F.log(share / F.col("part")) + other)) < CHANCE))
    plain = Words({})
    for r in kept.select("short", "word").collect():
        if math.isinf(plain.relation(r["short"], r["word"], True)):
            out.setdefault(r["word"], set()).add(r["short"])
    return {w: frozenset(n) for w, n in out.items()}


_registers: dict[str, Register] = {}


def _register(name: str, *parts) -> Register:
    """The register of one run, built once per worker."""
    if name not in _registers:
        _registers.clear()
        _registers[name] = Register(*parts)
    return _registers[name]


def attach_variants(mentions: DataFrame, register: DataFrame, max_register: int = 200_000) -> DataFrame:
    """(mention_id, entity_id) of mentions of an entity of ``register`` under another spelling.

    ``mentions``: mention_id, type, name, aliases; ``register``: entity_id,
    type, name. A name that is a register name character for character is no
    variant. Rows with a null id, type or name, or an empty name, mean no
    entity; null or empty aliases say nothing; types compare in lower case and
    only names of one type meet. A spelling that fits two entities equally
    well is left unattached, as is one that fits none well enough. Repeated
    rows count once; extra columns are ignored; empty tables give no rows.

    The register is broadcast: it is a fixed list, and a longer one than
    ``max_register`` is refused. Spellings and counts stay distributed; the
    join that hands the findings back splits off hot spellings.
    """
    spark = mentions.sparkSession
    known = register.where("entity_id is not null and type is not null and name is not null").select("entity_id", F.lower(F.trim("type")).alias("type"), "name").distinct()
    rows = mentions.where("mention_id is not null and type is not null and name is not null").select("mention_id", F.lower(F.trim("type")).alias("type"), "name", F.coalesce(F.array_sort(F.array_distinct(F.array_compact("aliases"))), F.array().cast("array<string>")).alias("aliases")).distinct()
    plain = cut(normalize_columns(rows.withColumn("raw", F.col("name")), ["name"]))
    spelled = plain.groupBy("type", "name", "aliases").agg(F.count(F.lit(1)).alias("n"))
    exact = plain.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), ["type", "name"]).select("entity_id", "n")
    counts = dict(exact.toPandas().itertuples(index=False)) if known.limit(max_register + 1).count() <= max_register else None
    if counts is None:
        raise ValueError(f"the register has more than {max_register} names")
    entries = [(r["entity_id"], r["type"], r["name"], int(counts.get(r["entity_id"], 0))) for r in known.orderBy("entity_id").collect()]
    shorts = short_forms(spelled, [name for _, kind, name, _ in entries if kind == "person"])
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, entries, shorts))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reg = _register(*shared.value)
        for part in parts:
            found = [reg.attach(k, n, list(a), c) for k, n, a, c in zip(part["type"], part["name"], part["aliases"], part["n"])]
            part["entity_id"] = pd.array(found, dtype="Int64")
            yield part.loc[part["entity_id"].notna(), ["type", "name", "aliases", "entity_id"]]

    # Rows are small and dear to score: adaptive execution would put them into few tasks.
    spread = spelled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("type", "name", "aliases"))
    found = spread.mapInPandas(run, "type string, name string, aliases array<string>, entity_id bigint")
    back = lookup_join(plain, found, ["type", "name", "aliases"]).where("entity_id is not null")
    names = known.select("entity_id", F.col("name").alias("_canonical"))
    return back.join(F.broadcast(names), "entity_id").where("raw <> _canonical").select("mention_id", "entity_id").distinct()
