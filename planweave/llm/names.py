"""Problem 2: variant spellings of names typed by people.

Each distinct spelling of a document is parsed into tokens with phonetic codes (Han characters by their readings,
Latin words by Soundex), blocked by phonetic codes of its sorted tokens, and compared only inside blocks: Jaro-Winkler
over readings and letters decides, beside tables of nicknames, titles, levels and ranks. Accepted pairs, and the aliases that
canonical records give, are clustered by connected components. Short forms that could stand for several bodies or
persons (initials, a surname with a title, a body without its level) join a cluster only when the document holds
exactly one that they fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.components import connected_groups
from planweave.llm.lookalikes import appearance, image
from planweave.session import cut

ORGANISATION, PERSON = "组织机构", "人员"
#: Administrative levels, numerals and what may follow a personal name.
LEVELS = "省市县区镇乡村州盟旗"
NUMERALS = "一二三四五六七八九十百零〇两0123456789ⅠⅡⅢⅣ甲乙丙丁"
TITLES = "副主任 主任 副局长 局长 副站长 站长 副科长 科长 副书记 书记 大队长 中队长 支队长 分队长 副队长 队长 副所长 所长 副处长 处长 镇长 县长 市长 区长 乡长 村长 总指挥 副指挥 指挥长 指挥 教授 老师 组长 部长 主席 委员 秘书长 秘书 院长 校长 主管 师傅 同志 先生 女士 医生 大夫 护士 护士长 总工程师 工程师 经理 总经理 厂长 班长 连长 政委 参谋 专家".split()
COMPOUND = "欧阳 上官 司马 诸葛 皇甫 司徒 尉迟 公孙 慕容 令狐 夏侯 东方 端木 百里 南宫 独孤 宇文 长孙 轩辕 钟离 澹台 申屠".split()
#: Other names of a kind of body that leave out more than signs.
UNIT_NAMES = {"委员会": "局", "卫健委": "卫健局", "卫计委": "卫健局", "抢修队": "抢修公司"}
#: Fixed value: the readings after which a health body's name may insert the sign for committee.
COMMITTEE = ("wei", "jian", "wei", "yuan")
#: Ranks of teams.
RANKS = "总支大中分小"
LATIN_TITLES = set("mr mrs ms miss dr prof capt captain insp inspector sgt sergeant lt lieutenant col colonel maj major gen general chief officer director supt superintendent eng engineer cdr commander cpl fr sir rev hon".split())
LATIN_LEVELS = "district county borough city town township province region municipality village parish".split()
LEVEL_SHORT = {"dist": "district", "distr": "district", "co": "county", "cnty": "county", "boro": "borough", "bor": "borough", "mun": "municipality", "prov": "province"}
#: Common English short names and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "al": "albert alexander alan", "alec": "alexander", "alex": "alexander alexandra", "sandy": "alexander alexandra", "andy": "andrew andrea", "andie": "andrea", "drea": "andrea", "annie": "anne", "tony": "anthony antonia",
    "bart": "bartholomew", "ben": "benjamin", "benny": "benjamin", "bea": "beatrice", "bernie": "bernard", "kate": "katherine catherine", "kathy": "katherine catherine", "katie": "katherine catherine", "kit": "katherine christopher", "kitty": "katherine", "kay": "katherine",
    "cathy": "catherine", "charlie": "charles charlotte", "chuck": "charles", "chas": "charles", "lottie": "charlotte", "chris": "christopher christine christina", "tina": "christina", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "deb": "deborah",
    "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "dora": "dorothy theodora", "ed": "edward edmund edwin", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore", "nell": "eleanor", "nellie": "eleanor",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "bess": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "fran": "frances francis", "fanny": "frances", "frannie": "frances", "frankie": "frances francis", "frank": "francis franklin",
    "fred": "frederick alfred", "freddie": "frederick", "geoff": "geoffrey", "jeff": "jeffrey", "georgie": "george georgina", "greg": "gregory", "gwen": "gwendolyn", "hal": "henry harold", "harry": "henry harold harrison", "hank": "henry", "ike": "isaac", "izzy": "isabel", "bella": "isabella",
    "jim": "james", "jimmy": "james", "jamie": "james", "jan": "janet", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jeremy", "jack": "john jackson", "johnny": "john", "jon": "jonathan", "joe": "joseph", "joey": "joseph", "jo": "josephine joanna", "josie": "josephine", "josh": "joshua", "judy": "judith",
    "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lou": "louis louise", "lucy": "lucille", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "madge": "margaret", "marge": "margaret marjorie", "greta": "margaret", "molly": "mary", "polly": "mary", "matt": "matthew", "mattie": "matilda", "mick": "michael", "mike": "michael", "mickey": "michael",
    "millie": "mildred", "nan": "nancy", "nat": "nathaniel nathan", "nick": "nicholas", "nicky": "nicholas nicola", "nicola": "nicole", "pat": "patrick patricia", "paddy": "patrick", "patty": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "richie": "richard",
    "rob": "robert", "bob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert albert herbert", "rod": "roderick", "ron": "ronald", "roz": "rosalind", "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel", "steve": "stephen steven", "sue": "susan", "susie": "susan", "terry": "terence theresa", "tess": "theresa", "tom": "thomas", "tommy": "thomas", "tim": "timothy",
    "val": "valerie", "vic": "victor", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vince": "vincent", "wally": "walter", "walt": "walter", "wendy": "gwendolyn", "bill": "william", "billy": "william", "will": "william", "willie": "william", "liam": "william", "winnie": "winifred", "zach": "zachary",
}


def readings(spark: SparkSession) -> dict[str, str]:
    """Reading without tone of every Han character, by the public transliterator that Spark ships with; a table of fixed size."""
    chars = [chr(o) for o in range(0x4E00, 0xA000)]
    make = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")
    lines = make.transliterate("\n".join(chars)).split("\n")
    return {c: r for c, r in zip(chars, (x.strip().replace("'", "") for x in lines)) if r.isascii() and r.isalpha()}


_table: dict[str, str] = {}


def use_readings(table: dict[str, str]) -> None:
    if not _table:
        _table.update(table)


def syllables(text: str) -> tuple[str, ...]:
    return tuple(_table.get(c, c) for c in text)


@lru_cache(100_000)
def soundex(word: str) -> str:
    codes = {**dict.fromkeys("bfpv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}
    out, last = word[:1], codes.get(word[:1], "")
    for c in word[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "hw":
            last = code
    return out[:4].ljust(4, "0")


def jaro_winkler(a, b) -> float:
    """Similarity of two strings or sequences of readings, the better of both directions.

    The window in which elements match is at least one wide, so that a swap counts in short ones too, and of equal
    elements in it the nearest is taken, of two as near the one on the side where the longer goes on, so that a repeated one does not look moved.
    """
    return 1.0 if a == b else max(_jaro_winkler(a, b), _jaro_winkler(b, a))


@lru_cache(None)
def _offsets(reach: int, right: bool) -> tuple[int, ...]:
    return (0, *(x for d in range(1, reach + 1) for x in ((d, -d) if right else (-d, d))))


def _jaro_winkler(a, b) -> float:
    offsets = _offsets(max(1, max(len(a), len(b)) // 2 - 1), len(b) > len(a))
    used, first, n = [False] * len(b), [], len(b)
    for i, c in enumerate(a):
        for d in offsets:
            j = i + d
            if 0 <= j < n and not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: What one slip, and two, may cost of the Jaro-Winkler similarity of sequences whose lengths differ by so much, times the length: a wrong element costs 2/3, a missing one 1/3, less after a common beginning.
ONE_SLIP, TWO_SLIPS = {0: 2 / 3, 1: 1 / 3}, {0: 1.2, 1: 0.95, 2: 0.7}
#: The similarity that the sorted readings of two Han persons must reach: another given name is another person.
SAME_READINGS = 0.995
#: The similarity that a short form must reach with the readings of its full form.
SHORT_FORM = 0.5


def slips(a, b, most: int = 1) -> int:
    """How many slips the Jaro-Winkler similarity of two sequences of about one length stands for: 0, 1, 2, or ``most + 1`` where they are not alike."""
    if a == b:
        return 0
    n, apart = max(len(a), len(b)), abs(len(a) - len(b))
    if apart >= (3 if most > 1 else 2):
        return most + 1
    if sum(x in b for x in a) < n - most - apart * (len(a) < len(b)):
        return most + 1  # so few elements in common that the similarity is below every bound
    lost = (1 - jaro_winkler(a, b)) * n - 1e-9
    if lost <= ONE_SLIP.get(apart, 0):
        return 1
    return 2 if most > 1 and lost <= TWO_SLIPS[apart] else most + 1


def _subsequence(short, long) -> bool:
    it = iter(long)
    return all(any(x == y for y in it) for x in short)


_HAN = re.compile("[㐀-鿿]")
_BRACKET = re.compile(r"^(.+?)\((.+?)\)$")


class Name:
    """One spelling, parsed. ``kind``: ho/lo organisations and hp/lp persons in Han or Latin letters, with what the comparison needs."""

    __slots__ = ("kind", "form", "han", "codes", "tokens", "level", "place", "unit", "numbers", "surname", "given", "partial", "titled")

    def __init__(self, form: str, person: bool):
        self.form, self.partial, self.titled = form, "", False
        self.surname = self.given = self.level = self.place = ""
        self.unit, self.numbers, self.tokens, self.codes, self.han = (), "", (), (), ""
        if _HAN.search(form):
            (self._han_person if person else self._han_body)(form)
        else:
            (self._latin_person if person else self._latin_body)(form)

    def _han_body(self, form: str) -> None:
        self.kind = "ho"
        text = form.replace(" ", "")
        if m := _BRACKET.match(text):
            text = m[2] + m[1]
        elif text.count(",") == 1:
            a, b = text.split(",")
            text = b + a
        text = re.sub(r"^..省(?=.{5})", "", text)
        read = syllables(text)
        for k in range(2, len(read) - 4):
            if read[k : k + 4] == COMMITTEE:
                text = text[: k + 2] + text[k + 4 :]
                break
        for known, common in UNIT_NAMES.items():
            if text.endswith(known):
                text = text[: -len(known)] + common
        self.han, self.codes = text, syllables(text)
        self.numbers = "".join(c for c in text if c in NUMERALS)
        if m := re.match(rf"^(.{{3}}|.{{2}})([{LEVELS}])(?![{LEVELS}])(.{{2,}})$", text):
            self.place, self.level, self.unit = m[1], m[2], syllables(m[3])

    def _han_person(self, form: str) -> None:
        self.kind = "hp"
        text = re.sub(r"[\s·.,]", "", form)
        for t in sorted(TITLES, key=len, reverse=True):
            if text.endswith(t) and len(text) > len(t):
                text, self.titled = text[: -len(t)], True
                break
            if text.startswith(t) and len(text) > len(t) + 1:
                text, self.titled = text[len(t) :], True
                break
        if len(text) > 1 and text[0] in "老小" and (len(text) == 2 or text[1:] in COMPOUND):
            self.partial, self.surname = "surname", "".join(syllables(text[1:]))
        elif len(text) == 2 and text[1] in "哥姐叔姨伯" and not self.titled:
            self.partial, self.given = "last", syllables(text[:1])[0]
        elif self.titled and (len(text) == 1 or text in COMPOUND):
            self.partial, self.surname = "surname", "".join(syllables(text))
        else:
            n = 2 if text[:2] in COMPOUND and len(text) > 2 else 1
            self.han, self.codes = text, syllables(text)
            self.surname, self.given = "".join(self.codes[:n]), "".join(self.codes[n:])
        self.tokens = tuple(sorted(self.codes))

    def _latin_person(self, form: str) -> None:
        self.kind = "lp"
        text = re.sub(r"(?<=\w)-(?=\w)", "", form)
        words = [w for w in re.split(r"[\s.,]+", text) if w]
        lower = [w.lower() for w in words]
        if len(lower) > 1 and lower[0] in LATIN_TITLES:
            words, lower, self.titled = words[1:], lower[1:], True
        elif len(lower) > 1 and lower[-1] in LATIN_TITLES:
            words, lower, self.titled = words[:-1], lower[:-1], True
        long = [w for w in lower if len(w) > 1]
        initials = [w for w in lower if len(w) == 1]
        if len(long) == 1 and initials:
            self.partial, self.surname, self.given = "initial", long[0], initials[0]
        elif len(long) == 1 and self.titled:
            self.partial, self.surname = "surname", long[0]
        else:
            self.tokens = tuple(sorted(long))
            first = [w.lower() for w in words if len(w) > 1]
            if len(first) == 2:
                turned = "," in form or (words[0].isupper() and not words[-1].isupper() and len(words[0]) > 1)
                self.surname, self.given = (first[0], first[1]) if turned else (first[1], first[0])

    def _latin_body(self, form: str) -> None:
        self.kind = "lo"
        text = form.lower().replace("&", " and ").strip()
        text = re.sub(r"^the\s+", "", text)
        if text.count(",") == 1:
            a, b = text.split(",")
            text = b + " " + a
        elif m := re.match(r"^(.+)\s+of\s+(\S+(?:\s+\S+)?)$", text):
            text = m[2] + " " + m[1]
        words = [w for w in re.split(r"[\s.\-]+", text) if w]
        out = []
        for k, w in enumerate(words):
            if w in LEVEL_SHORT and k in (1, 2):
                w = LEVEL_SHORT[w]
            elif k in (1, 2) and not self.level and len(w) > 4:
                w = next((x for x in LATIN_LEVELS if slips(w, x) <= 1), w)
            if w in LATIN_LEVELS and not self.level and k in (1, 2):
                self.level = w
                self.place = " ".join(out)
                out = []
                continue
            if w not in ("and", "the", "of", "for") and sorted(w) != ["a", "d", "n"]:
                out.append(w)
        if self.level:
            self.unit = tuple(out)
        elif len(words) == 1 and 3 <= len(words[0]) <= 8 and form.replace(".", "").isupper():
            self.partial, self.tokens = "acronym", (words[0],)
            return
        elif len(out) > 2:
            self.partial, self.place, self.unit = "level", out[0], tuple(out[1:])
        else:
            self.unit = tuple(out)
        self.numbers = "".join(c for c in form if c.isdigit())
        self.tokens = tuple(sorted([*([self.place] if self.place else []), *self.unit]))

    def keys(self) -> list[str]:
        """Block keys: phonetic codes of sorted tokens and of parts of them, so that one slip leaves some key untouched.

        A key under ``s`` brings together all that have it; under ``p`` a form that may be short meets the full
        forms that have the key under ``f``, and short forms do not meet one another.
        """
        return list(dict.fromkeys({"ho": self._han_body_keys, "lo": self._latin_body_keys, "hp": self._person_keys, "lp": self._person_keys}[self.kind]()))

    def _han_body_keys(self) -> list[str]:
        c = self.codes
        tokens = sorted(c)
        # all sorted codes, and all but each one: two bodies a slip apart share such a set, and hardly any others do
        own = ["s" + _digest(tokens)] + ["s" + _digest(tokens[:k] + tokens[k + 1 :]) for k in range(len(c)) if len(c) >= 5]
        full = bool(self.level) and len(self.unit) >= 3 or len(c) >= 8
        ends = {c[0] + " " + c[-1], " ".join(sorted(c[:3]))}
        known = set(ends)
        for k in range(1, min(6, len(c) - 1)):
            if self.han[k] in LEVELS:
                # a short form keeps the first sign of the unit, or the last, or begins with one from within
                for head in (f"{c[0]}{self.han[k]}", f"{c[k - 1]}/{self.han[k]}"):
                    ends |= {f"{head}>{c[k + 1]}", f"{head}<{c[-1]}"}
                    known |= {f"{head}>{x}" for x in c[k + 1 :]} | {f"{head}<{c[-1]}"}
        return own + ["pb" + x for x in sorted(ends)] + ["fb" + x for x in sorted(known) if full]

    def _latin_body_keys(self) -> list[str]:
        if self.partial == "acronym":
            return ["pa" + self.tokens[0]]
        own = ["so" + " ".join(sorted(soundex(w) for w in self.tokens))]
        if self.place and self.unit:
            own += ["sp" + soundex(self.place.split()[0]) + self.unit[0][0], "su" + self.place[:1] + " ".join(w[0] for w in self.unit)]
            if self.level:
                own.append("fa" + "".join(w[0] for w in (*self.place.split(), self.level, *self.unit)))
        return own

    def _person_keys(self) -> list[str]:
        if self.partial == "last":
            return ["pg" + self.given]
        sounds = [self.surname] + [soundex(self.surname)] * (self.kind == "lp")
        if self.partial:
            return ["pn" + x for x in sounds] + ["fn" + x for x in sounds] * (self.partial == "initial")
        if self.kind == "hp":
            return ["sp" + " ".join(self.tokens), "sn" + " ".join(sorted((self.surname, self.given))), "fn" + self.surname] + ["fg" + self.codes[-1]] * (len(self.codes) > 1)
        if len(self.tokens) != 2:
            return ["sl" + " ".join(self.tokens)]
        own = ["sn" + " ".join(self.tokens)] + ["fg" + r for r in _last_readings(self.tokens)]
        ends = [{e for known in (w, *NICKNAMES.get(w, "").split()) for e in _ends(known)} for w in self.tokens]
        own += ["se" + " ".join(sorted((e, f))) for e in ends[0] for f in ends[1]]
        for w, x in (self.tokens, self.tokens[::-1]):
            own += ["fn" + w, "fn" + soundex(w)]
            for known in (w, *NICKNAMES.get(w, "").split()):
                own += ["sx" + soundex(known) + x[0], "sx" + soundex(known) + "~" + x[-1]]
        return own


def _digest(codes: list[str]) -> str:
    """A short name for a list of codes; two lists of one name cost only a comparison."""
    return str(crc32(" ".join(codes).encode()))


def _ends(word: str) -> list[str]:
    """First and last letters of a Latin word, so that two words that differ in one slip share some: of up to four letters also one by one."""
    return ["^" + word[:2], "$" + word[-2:]] + (["^" + word[:1], "$" + word[-1:]] if len(word) < 5 else [])


def _same_given(a: str, b: str) -> bool:
    return bool({a, *NICKNAMES.get(a, "").split()} & {b, *NICKNAMES.get(b, "").split()})


def _close(a: str, b: str, most: int) -> int:
    """Slips between two Latin words by their Jaro-Winkler similarity, or a large number when they are no slip of one another."""
    d = slips(a, b, most)
    if d == 0:
        return 0
    least = 0.8 if d == 1 else 0.9
    return d if d <= most and min(len(a), len(b)) >= 3 and (d == 1 or a[0] == b[0]) and jaro_winkler(a, b) >= least else 99


def _pinyin_word(word: str) -> bool:
    """Whether a Latin word is one to three readings of Han characters."""
    return _pinyin_parts(word) is not None


@lru_cache(100_000)
def _pinyin_parts(word: str, most: int = 3) -> tuple[str, ...] | None:
    known = _syllable_set()
    if word in known:
        return (word,)
    if most > 1:
        for k in range(min(6, len(word) - 1), 0, -1):
            if word[:k] in known and (rest := _pinyin_parts(word[k:], most - 1)):
                return (word[:k], *rest)
    return None


@lru_cache(1)
def _syllable_set() -> frozenset[str]:
    return frozenset(_table.values())


def _last_readings(words: tuple[str, ...]) -> list[str]:
    """The last reading of each of two words that are both made of readings."""
    parts = [_pinyin_parts(w) for w in words]
    return [p[-1] for p in parts if p] if len(parts) == 2 and all(parts) else []


def _persons(a: Name, b: Name) -> str:
    if a.partial or b.partial:
        if a.partial and b.partial:
            same = {a.partial, b.partial} == {"surname", "initial"} and a.kind == b.kind and a.surname == b.surname
            return ("weak" if a.partial == "surname" else "weak<") if same else ""
        short, full = (a, b) if a.partial else (b, a)
        if short.partial == "last":
            if full.kind == "hp":
                return "weak" if len(full.codes) > 1 and full.codes[-1] == short.given else ""
            return "weak" if short.given in _last_readings(full.tokens) else ""
        if full.kind == "hp":
            orders = [(full.surname, full.given)]
        elif len(full.tokens) == 2:
            orders = [(full.surname, full.given)] if not all(map(_pinyin_word, full.tokens)) else [full.tokens, full.tokens[::-1]]
        else:
            return ""
        for surname, given in orders:
            if short.surname == surname or (short.kind == full.kind == "lp" and _close(short.surname, surname, 1) <= 1):
                if short.partial == "surname" or any(x[:1] == short.given for x in (given, *NICKNAMES.get(given, "").split())):
                    return "weak"
        return ""
    if a.kind != b.kind:
        han, latin = (a, b) if a.kind == "hp" else (b, a)
        if len(latin.tokens) != 2 or len(han.codes) < 2:
            return ""
        return "strong" if jaro_winkler(" ".join(sorted((han.surname, han.given))), " ".join(latin.tokens)) >= SAME_READINGS else ""
    if a.kind == "hp":
        return "strong" if len(a.codes) > 1 and jaro_winkler(" ".join(a.tokens), " ".join(b.tokens)) >= SAME_READINGS else ""
    if len(a.tokens) != 2 or len(b.tokens) != 2:
        return "strong" if a.tokens and a.tokens == b.tokens else ""
    if a.tokens == b.tokens:
        return "strong"
    if all(map(_pinyin_word, (*a.tokens, *b.tokens))):
        return ""
    for x, y in ((b.surname, b.given), (b.given, b.surname)):
        by_surname = _close(a.surname, x, 2)
        if _same_given(a.given, y) and by_surname <= 2:
            return "strong"
        by_given = min((_close(g, h, 2) for g in {a.given, *NICKNAMES.get(a.given, "").split()} for h in {y, *NICKNAMES.get(y, "").split()}), default=99)
        if by_surname == 0 and by_given <= 2 or by_surname + by_given <= 2:
            return "strong"
    return ""


def _one_slip(a: Name, b: Name) -> bool:
    """Whether two Han bodies differ in at most one sign that is neither a numeral nor a level."""
    x, y = a.codes, b.codes
    if x == y:
        return all(c == d or c not in LEVELS or d not in LEVELS for c, d in zip(a.han, b.han))
    if slips(x, y) > 1 or min(len(x), len(y)) < 5:
        return False
    levels = [[c for c in n.han if c in LEVELS] for n in (a, b)]
    if levels[0] != levels[1] and len(levels[0]) == len(levels[1]):
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    changed = {a.han[k : k + 1], b.han[k : k + 1]} if len(x) == len(y) else {(a.han if len(x) > len(y) else b.han)[k : k + 1]}
    if len(x) == len(y) and k + 1 < len(x) and x[k] == y[k + 1] and x[k + 1] == y[k]:
        return True
    if len(x) == len(y) and (changed <= set(LEVELS) or changed <= set(RANKS)):
        return False
    return len(x) == len(y) or not (changed & set(LEVELS))


def _short_unit(rest: tuple[str, ...], unit: tuple[str, ...], allowed: int) -> bool:
    """Whether ``rest`` leaves out signs of ``unit``, with at most ``allowed`` signs wrong."""
    inside = any(unit[k : k + len(rest)] == rest for k in range(len(unit) - len(rest) + 1))
    if len(rest) < 2 or rest[-1] != unit[-1] and rest[0] != unit[0] and not inside:
        return False
    if _subsequence(rest, unit):
        return True
    if not allowed or len(rest) < 3:
        return False
    swapped = any(_subsequence(rest[:k] + (rest[k + 1], rest[k]) + rest[k + 2 :], unit) for k in range(len(rest) - 1))
    doubled = any(rest[k] == rest[k + 1] and _subsequence(rest[:k] + rest[k + 1 :], unit) for k in range(len(rest) - 1))
    if swapped or doubled or len(rest) < 4:
        return swapped or doubled
    return slips(rest, unit) <= 1 or any(_subsequence(rest[:k] + rest[k + 1 :], unit) for k in range(len(rest)))


def _short_for(short: Name, full: Name, slips_allowed: int) -> bool:
    """Whether a Han body may be ``full`` with its place or its unit shortened: the place without its level or as first sign and level, the unit with signs left out."""
    if len(short.codes) < 4 or len(short.codes) > len(full.codes) and (short.level or not full.level):
        return False
    if not full.level:
        return len(full.codes) >= 8 and short.codes[:3] == full.codes[:3] and short.han[3] not in LEVELS and _short_unit(short.codes[3:], full.codes[3:], slips_allowed)
    if not short.level and len(short.codes) >= 8 and short.codes[:3] == full.codes[:3] and _short_unit(full.unit, short.codes[3:], slips_allowed):
        return True
    if len(full.unit) < 3:
        return False
    place, level = syllables(full.place), syllables(full.level)
    for head in (place + level, place, place[:1] + level):
        whole = head is not place and len(head) > len(place)
        for n in (len(head), len(head) - 1, len(head) + 1) if len(head) > 2 else (len(head),):
            wrong = slips(short.codes[:n], head)
            if wrong > min(slips_allowed, len(head) > 2) or n > len(short.codes) - 2:
                continue
            if head == place:
                if short.han[n] in LEVELS and short.codes[n] != full.unit[0] or n > len(head) and short.han[n - 1] in LEVELS:
                    continue
            elif short.han[n - 1] != full.level:
                continue
            if whole and wrong and short.codes[n - 1] != level[0]:
                continue
            if _short_unit(short.codes[n:], full.unit, slips_allowed - wrong):
                return True
    return False


def _bodies(a: Name, b: Name) -> str:
    if a.kind != b.kind:
        return ""
    if a.kind == "ho":
        if a.numbers != b.numbers:
            return ""
        if _one_slip(a, b):
            return "strong"
        if jaro_winkler(a.codes, b.codes) < SHORT_FORM:
            return ""
        for allowed, verdict in ((0, "weak"), (1, "faint")):
            if _short_for(a, b, allowed):
                return verdict
            if _short_for(b, a, allowed):
                return verdict + "<"
        return ""
    if a.numbers != b.numbers:
        return ""
    if "acronym" in (a.partial, b.partial):
        if a.partial == b.partial:
            return ""
        short, full = (a, b) if a.partial else (b, a)
        letters = "".join(w[0] for w in (*full.place.split(), full.level, *full.unit) if w)
        return ("weak" if short is a else "weak<") if full.level and short.tokens[0] == letters else ""
    if a.level and b.level and a.level != b.level:
        return ""
    if len(a.unit) != len(b.unit) or not a.unit or bool(a.place) != bool(b.place):
        return ""
    wrong = _close(a.place, b.place, 2) if a.place else 0
    for x, y in zip(a.unit, b.unit):
        if x == y:
            continue
        s, l = sorted((x, y), key=len)
        if len(s) < len(l) and s[0] == l[0] and len(s) <= 6 and _subsequence(s, l) and len(l) - len(s) >= 2:
            continue
        wrong += _close(x, y, 2)
    if wrong > 2 or (wrong == 2 and not a.place):
        return ""
    if a.level and b.level or not a.level and not b.level:
        return "strong"
    return "weak" if b.level else "weak<"


def compare(a: Name, b: Name) -> str:
    """``strong``: the same; ``weak``: ``a`` may be short for ``b``, ``faint``: so with a slip beside, ``weak<``, ``faint<``: the other way; '' for others."""
    if a.kind[1] == "p":
        verdict = _persons(a, b)
        return "weak<" if verdict == "weak" and b.partial and not a.partial else verdict
    return _bodies(a, b)


@lru_cache(50_000)
def parse(form: str, person: bool) -> Name:
    return Name(form, person)


@lru_cache(100_000)
def judged(a: str, b: str, person: bool) -> str:
    """The verdict on two spellings, remembered, as the same two come in many documents."""
    return compare(parse(a, person), parse(b, person))


def spellings(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``form``, the spelling without what a reader cannot see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(form=[image(appearance(s)) for s in batch[name]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", form string"
    return rows.mapInPandas(run, schema)


def named(entities: DataFrame) -> DataFrame:
    """``(document_id, entity_type, name, form, entity_id)`` of organisations and persons with a name; rows delivered twice come once."""
    some = entities.where(F.col("entity_type").isin(ORGANISATION, PERSON) & F.col("document_id").isNotNull() & F.col("entity_id").isNotNull() & F.col("name").isNotNull())
    return spellings(some.select("document_id", "entity_type", "name", "entity_id").distinct(), "name").where("form <> ''")


def aliases(canonical: DataFrame) -> DataFrame:
    """``(document_id, entity_type, canon_id, form)`` for the name and every alias of canonical organisations and persons."""
    some = canonical.where(F.col("entity_type").isin(ORGANISATION, PERSON) & F.col("document_id").isNotNull() & F.col("canon_id").isNotNull())
    both = some.select("document_id", "entity_type", "canon_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return spellings(both.where("name is not null").distinct(), "name").where("form <> ''").select("document_id", "entity_type", "canon_id", "form").distinct()


def _node() -> Column:
    return F.xxhash64("document_id", "entity_type", "form")


def links(forms: DataFrame, table) -> DataFrame:
    """``(a, b, verdict)`` of the spellings of one document and type that share a block; ``a`` and ``b`` are node ids, verdict as in ``compare``."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_readings(table.value)
        for batch in batches:
            yield batch.assign(keys=[parse(f, t == PERSON).keys() for f, t in zip(batch["form"], batch["entity_type"])])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_readings(table.value)
        for batch in batches:
            verdict = [judged(x, y, p) for x, y, p in zip(batch["form_a"], batch["form_b"], batch["person"])]
            out = batch[["a", "b"]].assign(verdict=verdict)
            yield out[out["verdict"] != ""]

    blocked = forms.mapInPandas(block, "document_id string, entity_type string, form string, node long, keys array<string>")
    by_key = blocked.select("document_id", "entity_type", "form", "node", F.explode("keys").alias("k"))
    # a block is named by two hashes, 128 bits, instead of the document's and the key's own strings
    name = [F.xxhash64("document_id", "entity_type", F.expr("substring(k, 2)")).alias("block"), F.xxhash64(F.expr("substring(k, 2)"), "document_id").alias("check")]
    keyed = cut(by_key.select(*name, "node", F.substring("k", 1, 1).alias("side")))
    left = keyed.where("side <> 'f'").select("block", "check", F.col("side").alias("side_a"), F.col("node").alias("a"))
    right = keyed.where("side <> 'p'").select("block", "check", F.col("side").alias("side_b"), F.col("node").alias("b"))
    met = left.join(right, ["block", "check"]).where("side_a = 's' and side_b = 's' and a < b or side_a = 'p' and side_b = 'f' and a <> b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    spelt = forms.select("node", "form", (F.col("entity_type") == PERSON).alias("person"))
    whole = pairs.join(spelt.select(F.col("node").alias("a"), F.col("form").alias("form_a"), "person"), "a").join(spelt.select(F.col("node").alias("b"), F.col("form").alias("form_b")), "b")
    return whole.mapInPandas(judge, "a long, b long, verdict string")


def clusters(entities: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named rows with their ``node``, and ``(id, group_id)`` of every spelling's node."""
    spark = entities.sparkSession
    rows = cut(named(entities).withColumn("node", _node()))
    given = cut(aliases(canonical).withColumn("node", _node()))
    columns = ["document_id", "entity_type", "form", "node"]
    forms = cut(rows.select(columns).unionByName(given.select(columns)).distinct())
    table = spark.sparkContext.broadcast(readings(spark))
    judged = cut(links(forms, table))
    of_record = given.groupBy("canon_id").agg(F.min("node").alias("first"))
    by_alias = given.join(of_record, "canon_id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    strong = cut(judged.where("verdict = 'strong'").select("a", "b").unionByName(by_alias))
    firm = connected_groups(strong, "a", "b")
    group_of = cut(forms.select(F.col("node").alias("id"), F.length("form").alias("n")).join(firm, "id", "left").select("id", F.coalesce("group_id", "id").alias("g"), "n"))
    turned = F.col("verdict").endswith("<")
    weak = judged.where("verdict <> 'strong'").select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("short"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("full"), F.col("verdict").startswith("faint").cast("int").alias("faint"))
    lifted = weak.join(group_of.select(F.col("id").alias("short"), F.col("g").alias("short_g")), "short").join(group_of.select(F.col("id").alias("full"), F.col("g").alias("full_g")), "full")
    between = cut(lifted.where("short_g <> full_g").groupBy("short_g", "full_g").agg(F.min("faint").alias("faint")))
    # two groups may each hold a short form of the other; then the one with the longer name is the full one
    length = group_of.groupBy("g").agg(F.max("n").alias("n"))
    both_ways = between.drop("faint").join(between.select(F.col("full_g").alias("short_g"), F.col("short_g").alias("full_g")), ["short_g", "full_g"])
    ordered = both_ways.join(length.select(F.col("g").alias("short_g"), F.col("n").alias("short_n")), "short_g").join(length.select(F.col("g").alias("full_g"), F.col("n").alias("full_n")), "full_g")
    wrong = ordered.where(F.struct("short_n", "short_g") > F.struct("full_n", "full_g")).select("short_g", "full_g")
    between = cut(between.join(wrong, ["short_g", "full_g"], "left_anti"))
    shorts = between.select(F.col("short_g").alias("full_g")).distinct()
    # the full bodies and persons that a short form fits without a slip go before those it fits with one
    fits = between.join(shorts, "full_g", "left_anti").groupBy("short_g").agg(F.min(F.struct("faint", "full_g")).alias("best"), F.count_if(F.col("faint") == 0).alias("sure"), F.count(F.lit(1)).alias("n"))
    decided = fits.where("sure = 1 or sure = 0 and n = 1").select("short_g", F.col("best.full_g").alias("full_g"))
    # a full group is nobody's short form, so short groups and the one they join make stars: the components of both together
    joined = group_of.join(decided, F.col("g") == F.col("short_g"), "left")
    return rows, joined.select("id", F.coalesce("full_g", "g").alias("group_id"))


def groups(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(entity_id, group_id)`` of every named organisation and person; a name without variants is a group of its own."""
    rows, linked = clusters(entities, canonical)
    return rows.join(linked.withColumnRenamed("id", "node"), "node", "left").select("entity_id", F.coalesce("group_id", "node").alias("group_id")).distinct()


def found(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(entity_id_a, entity_id_b)`` of one document and type, whose names differ as strings and mean the same.

    Names that differ only in what a reader cannot see share a node and count too. Null and blank names, null
    documents and other types are no cases; rows delivered twice count once.
    """
    rows, linked = clusters(entities, canonical)
    placed = cut(rows.join(linked.withColumnRenamed("id", "node"), "node", "left").select("document_id", "entity_type", "name", "entity_id", F.coalesce("group_id", "node").alias("g")))
    names = placed.select("document_id", "entity_type", "g", "name").distinct()
    pairs = names.withColumnRenamed("name", "name_a").join(names.withColumnRenamed("name", "name_b"), ["document_id", "entity_type", "g"]).where("name_a < name_b")
    ids = placed.select("document_id", "entity_type", "g", "name", "entity_id")
    first = pairs.join(ids.withColumnRenamed("name", "name_a").withColumnRenamed("entity_id", "x"), ["document_id", "entity_type", "g", "name_a"])
    both = first.join(ids.withColumnRenamed("name", "name_b").withColumnRenamed("entity_id", "y"), ["document_id", "entity_type", "g", "name_b"])
    return both.where("x <> y").select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b")).distinct()
