"""Problem 10: personal information inside free text.

One pass of a string automaton over each text finds anchors (roles and titles,
given names, street words, at signs); patterns are tried around anchors only.
Numbers are found by one pattern that starts at digits.

Names come by evidence, not from a list of all names.  Two to four capitalised
words after a role or title, or before words such as ``adlı``, are a name where
the case of the text around them says something, that is, where the text goes
on in lower case or ends there.  From these places given names are learnt over
the whole table (:func:`learn_names`): words that begin such names with at least
two different followers.  A learnt or common given name makes a name anywhere,
and so does the company of one: what stands in a row with a name by comma or
``ve`` is a name as well.  A name learnt holds at least one of ``NAME_SHARE``
such places, so there are at most NAME_SHARE.

Method of replacement: format-preserving Feistel pseudonyms.  Phone and
identity numbers that have a valid format are permuted under a key within that
format, so that equal values stay linked across documents and no two values
meet; the same permutation serves dates, where it is asked for (``dates``).  Names,
addresses and e-mail addresses, which have no fixed format, get a keyed token
of their normalised form.  Every pseudonym stands in a typed placeholder.
Tokens have 128 bits, so that no two values meet.

Defined cases: a null text stays null and holds nothing; an empty text stays
empty; masked values, initials, names inside companies, places or addresses,
and file, tracking, bar-code and account numbers do not count; spans never
overlap (the earlier and longer one counts); repeated rows give repeated
results; an empty input gives an empty result; other columns pass through, one
with the name of the result is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import add_columns, arrow_map
from corpusloom.storage import materialize

#: Given names that are among the most common ones of their country; all others are learnt.
COMMON_NAMES = """
Mehmet Mustafa Ahmet Ali Hüseyin Hasan İbrahim İsmail Osman Yusuf Murat Ömer Ramazan Halil Süleyman Abdullah Mahmut Recep Salih Fatih Kadir Emre Adem
Kemal Yaşar Bekir Musa Metin Orhan Hakan Serkan Volkan Burak Cem Tolga Sinan Engin Ercan Erdal Erol Erhan Cengiz Yavuz Selim Selçuk Şükrü Veli Hamza Harun Davut Yakup Yunus Eyüp İsmet Rıza Remzi Turgut
Vedat Zeki Bülent Cihan Ferhat Furkan Gökhan Kaan Kerem Koray Levent Oğuz Uğur Nuri Necati Cahit Cemal Tamer Salim Faruk Sedat Nihat Hikmet Serdar Okan
Aynur Aysel Ayten Songül Sevim Gülsüm Leyla Dilek Büşra Kübra Esma Meral Nurten Filiz Serpil Sibel Nermin Pınar Ebru Tuğba Burcu Gamze Seda Nuray Rabia Zübeyde Nalan
Fatma Ayşe Emine Hatice Zeynep Elif Meryem Şerife Zehra Sultan Hanife Merve Havva Zeliha Esra Özlem Hacer Yasemin Hülya Cemile
James John Robert Michael William David Richard Thomas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah
Hans Peter Klaus Wolfgang Jürgen Michael Stefan Thomas Maria Ursula Monika Petra Sabine Renate Anna Julia
""".split()
#: Words after which two capitalised words are a person.
ROLES = """
Davacı Davacılar Davalı Davalılar Tanık Tanıklar Sanık Sanıklar Müşteki Müştekiler Mağdur Mağdure Katılan Şikâyetçi Şüpheli Şüpheliler Hükümlü Tutuklu Bilirkişi
Kiracı Kiraya Alacaklı Borçlu Mirasçı Mirasçılar Mirasçıları Mirasbırakan Muris Vasi Kayyım Sürücü İşçi İşveren Müvekkil Müvekkilim Vekil Vekili Müdafi Müdafii
Hâkim Hakim Savcı Cumhuriyet Kâtip Zabıt Avukat Av. Dr. Doç. Prof. Sayın Bay Bayan Temyiz Başkan Üye Noter Memur Doktor
Mr. Mrs. Ms. Mr Mrs Ms Judge Justice Witness Claimant Defendant Plaintiff Applicant Appellant Respondent Counsel Heir Tenant Landlord Driver
Herr Herrn Frau Zeuge Zeugin Kläger Klägerin Beklagte Beklagter Angeklagte Angeklagter Richter Richterin Rechtsanwalt Rechtsanwältin Antragsteller Antragstellerin Mieter Mieterin Vermieter
""".split()
#: Words that are capitalised after a role but name no person.
NO_NAME = """
mahkeme mahkemesi mahkemece idare idaresi kurum kurumu kurul kurulu bakanlık bakanlığı başkan başkanı başkanlık vekil vekili vekilinin vekilleri müdafi müdafii asil
hâkim hakim hâkimi savcı savcısı savcılığı müdür müdürü şirket şirketi devlet hazine hazinesi belediye tarafın taraf tanık sanık davacı davalı müşteki katılan mağdur
borçlu alacaklı bilirkişi raporu beyanı beyanları ifadesi dilekçesi kararı karar dava davası dosya dosyası sayılı kanun kanunu maddesi tarihli daire dairesi genel
temyiz istinaf esas hüküm talep itiraz ile ise ve veya için olarak bu bir da de ki the of and for to der die das und von zu court tribunal office gericht amt ministry
cumhuriyet asliye ağır ceza sulh icra aile iş tüketici kadastro ticaret fikrî sınaî haklar bölge adliye yargıtay danıştay
""".split()
#: What follows a person's name.
_NAMED = r"(?:[  ]\((?:T\.?C\.?|TC|Ausweisnummer|identity)|[  ](?:adlı|isimli|adındaki|doğumlu)(?!\w))"
#: Words that are no surname; after a name they make it part of a street, place or company.
NO_SURNAME = """
sokak sokağı sok sk cadde caddesi cad cd bulvar bulvarı blv mahalle mahallesi mah mh meydanı parkı köprüsü köyü mevkii apartmanı apt sitesi sit blok
tekstil sanayi ticaret san tic ltd şti aş inşaat nakliyat gıda turizm otomotiv enerji holding grup şirketi limited anonim bank bankası sigorta vakfı
derneği kooperatifi hastanesi okulu lisesi üniversitesi fakültesi koleji eczanesi market oteli kaleminden mahkemesi dairesi başkanlığı müdürlüğü
belediyesi barosu hukuk bürosu ofisi yayınevi matbaası kitabevi fabrikası çiftliği havalimanı garı istasyonu stadı tüneli barajı
street lane road avenue square bridge park company gmbh inc llp plc ag hospital school
""".split()
#: What stands before or after a number that is none of a person.
_OTHER_NUMBER = re.compile(r"(?:takip|barkod\w*|fiş|hesap|fatura|dekont|sicil|seri|poliçe|abone\w*|referans|iban|işlem|kargo|dosya|evrak|tracking|parcel|bar-?code|account|receipt|invoice|konto\w*|sendung\w*|rechnung\w*)[\s.:]*(?:no\b|nr\b|number|numara\w*|kod\w*|nummer)?[\s.:#]*$", re.I)
_OTHER_AFTER = re.compile(r"\s*(?:numaralı|no’lu|nolu|sayılı)\s+(?:gönderi|işlem|hesap|fatura|poliçe|abone|fiş|dosya)", re.I)
_STREETS = r"(?:[Ss]okak|[Ss]okağı|[Ss]ok\.?|[Ss]k\.?|[Cc]addesi|[Cc]adde|[Cc]ad\.?|[Cc]d\.?|[Bb]ulvarı|[Bb]ulv\.?|[Bb]lv\.?|SOKAK|SOKAĞI|SOK\.?|SK\.?|CADDESİ|CADDE|CAD\.?|CD\.?|BULVARI|BULV\.?|BLV\.?)"
_STREET_ANCHORS = "Sokak Sokağı Sok. Sk. Sok, Sk, Cadde Cad. Cd. Bulvar Bulv. Blv SOKAK SOKAĞI SOK. SK. SOK, SK, CADDE CAD. CD. BULVAR BULV. BLV".split() + ["Sok ", "Sk ", "Cad ", "SOK ", "SK ", "CAD ", "Cad,", "CAD,"]
_ENGLISH_ANCHORS = [" Street", " Lane", " Road", " Avenue", "straße ", "strasse "]
_AT_ANCHORS = ["@", "(at)", "[at]", "(et)", "[et]", "(AT)", "[AT]"]

_CAP, _LOW = "A-ZÇĞİÖŞÜÂÎÛÄ", "a-zçğıöşüâîûäß"
_TOKEN = rf"(?:[{_CAP}][{_LOW}]+(?:-[{_CAP}][{_LOW}]+)?|[{_CAP}]{{2,}}(?:-[{_CAP}]+)?)(?![\w])"
_NEXT = re.compile(rf"[  ]({_TOKEN})")
_SURNAME_FIRST = re.compile(rf"(?<!\w)([{_CAP}]{{3,}}(?:-[{_CAP}]+)?), $")
_AFTER_ROLE = re.compile(rf"(?: ?[:,])?(?:[  ]|\n)(?:\d{{1,2}} ?[-.)] ?)?(?=[{_CAP}])")
_PERSON = re.compile(rf"({_TOKEN})(?:[  ]({_TOKEN}))(?:[  ]({_TOKEN}))?(?:[  ]({_TOKEN}))?")
_REVERSED = re.compile(rf"([{_CAP}]{{3,}}(?:-[{_CAP}]+)?), ({_TOKEN})(?:[  ]({_TOKEN}))?")
_GOES_ON = re.compile(rf"\s*(?:$|[{_LOW}(;/–-]|[’'][{_LOW}]|[.](?:\s|$)|[,:]\s*[\w(+“\"]|\n)")
_ROW = re.compile(r",[  ]|[  ](?:ve|ile|and|und)[  ]")
_NAMED_BEFORE = re.compile(rf"(?<![\w/.])({_TOKEN})[  ]({_TOKEN})(?:[  ]({_TOKEN}))?{_NAMED}")
_STARTS = re.compile(r"(?:\A|[.!?\n])\s*\Z")
NAME_SHARE, NAME_PLACES = 200_000, 2
_SEP = r"[ .\-]?"
_TEN = rf"{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}(?!\d|[-/]\d)"
_NUMBER = re.compile(
    r"[+(0-9](?<![\w/.,+\-][+(0-9])(?:"
    rf"(?:(?<=\+)90|(?<=0)090){_SEP}\(?[2-5]\d\d\)?{_TEN}"
    rf"|(?<=\()0 ?[2-5]\d\d\){_TEN}"
    rf"|(?<=0) ?\(?[2-5]\d\d\)?{_TEN}"
    r"|(?<=[1-9])(?P<id>\d\d(?:\d{8}|-\d{3}-\d{3}-\d\d| \d{3} \d{3} \d\d)(?!\d|[-/]\d|[.,]\d))"
    r")"
)
_PASSPORT = re.compile(r"(?<!\w)[A-Z] ?\d{8}(?!\w)")
_PASSPORT_BEFORE = re.compile(r"pas{1,2}a?port|reisepas", re.I)
_DOT = r"(?:\.| ?[(\[](?:nokta|dot|punkt|NOKTA|DOT)[)\]] ?)"
_EMAIL = re.compile(rf"(?<![\w.+\-@])[\w+\-]+(?:\.[\w+\-]+)*(?: ?[(\[](?:at|et|AT|ET)[)\]] ?| @ |@)[\w\-]+(?:{_DOT}[\w\-]+)+")
_NUM = r"(?:[Nn]o|NO|[Nn]umara)[.:]{0,2} ?\d+(?: ?/ ?\d+)?[A-Za-z]?(?!\w)"
_AFTER_STREET = re.compile(rf",? ?(?:{_NUM}|\d{{1,4}}(?: ?/ ?\d+)?(?![\w.]*\d|\w)(?:\.? ?(?:[Bb]lok|BLOK))?)(?:,? ?(?:[Dd]aire|[Dd]|D|DAİRE)[.: ]{{1,2}}\d+|,? ?(?:[Bb]lok|BLOK)?,? ?(?:[Kk]at|KAT)[.: ]{{1,2}}\d+)*(?:,? \d{{5}})?(?:,? (?!(?:{_STREETS})\b)[{_CAP}][\w]+(?:(?: ?/ ?| [–-] )[{_CAP}][\w]+)?)?")
_QUARTERS = r"(?:[Mm]ahallesi|[Mm]ah\.?|[Mm]h\.?|MAHALLESİ|MAH\.?|MH\.?)"
_BARRED = rf"(?!{_QUARTERS}(?!\w)|(?:Muhatap|Taşınmazın?|Davalı|Davacı|Sanık|Borçlu|Adres|Adresi|İkametgâh)\b)"
_STREET = re.compile(rf"(?<!\w)(?:(?:{_BARRED}[{_CAP}][{_LOW}{_CAP}]+|\d{{1,4}}\.) ){{1,2}}{_STREETS}(?!\w)")
_QUARTER_BEFORE = re.compile(rf"(?:(?<!\w){_BARRED}[{_CAP}][{_LOW}{_CAP}]+ ){{1,2}}{_QUARTERS},? ?$")
_ENGLISH = re.compile(rf"(?<![\w/.,])\d{{1,4}}[a-z]? [{_CAP}][\w’'-]+(?: [{_CAP}][\w’'-]+)? (?:Street|Lane|Road|Avenue)(?!\w)(?:, [{_CAP}]\w+)?")
_GERMAN = re.compile(rf"(?<!\w)[{_CAP}][\w-]*stra(?:ß|ss)e \d{{1,4}}[a-z]?(?!\w)(?:, \d{{5}} [{_CAP}]\w+)?")
_UPPER, _LOWER = str.maketrans("iı", "İI"), str.maketrans("İI", "iı")

NAME, ADDRESS, EMAIL, PHONE, NATIONAL_ID = "name", "address", "email", "phone", "national_id"
_STATE: dict = {}


def _upper(s: str) -> str:
    return s.translate(_UPPER).upper()


def _lower(s: str) -> str:
    return s.translate(_LOWER).lower()


def _state(names: tuple[str, ...] = ()) -> dict:
    """The automaton for the given names of a table, built once in a process."""
    if _STATE.get("names") is not names:
        import ahocorasick

        a, given = ahocorasick.Automaton(), set()
        for n in (*COMMON_NAMES, *names):
            title = n if n in COMMON_NAMES else "-".join(_upper(p[:1]) + p[1:] for p in n.split("-"))
            for form in (title, _upper(title), title.upper()):
                given.add(form)
        for form in given:
            a.add_word(form, (NAME, len(form)))
        for x in ROLES:  # a role that is a given name as well stays a role
            for form in {x, _upper(x), _lower(x)}:
                a.add_word(form, ("role", len(form)))
        for word in ("adlı", "isimli", "adındaki", "doğumlu", "(T.C", "(TC", "(Ausweis", "(identity"):
            a.add_word(word, ("named", len(word)))
        for x in _STREET_ANCHORS:
            a.add_word(x, ("street", len(x)))
        for x in _ENGLISH_ANCHORS:
            a.add_word(x, ("foreign", len(x)))
        for x in _AT_ANCHORS:
            a.add_word(x, ("at", len(x)))
        for x in ("assport", "asaport", "ASSPORT", "ASAPORT", "eisepas"):
            a.add_word(x, ("passport", len(x)))
        a.make_automaton()
        _STATE.update(names=names, automaton=a, given=given, bad=frozenset(NO_SURNAME), none=frozenset(NO_NAME) | {_lower(r) for r in ROLES})
    return _STATE


def _is_bad(token: str) -> bool:
    return _lower(token).rstrip(".") in _STATE["bad"]


def _name_at(text: str, start: int, end: int, used: list[int]) -> tuple[int, int] | None:
    """The span of a name whose given name stands at [start, end)."""
    given = _STATE["given"]
    last, tokens = end, 1
    while tokens < 4 and (m := _NEXT.match(text, last)):
        word = m.group(1)
        if _is_bad(word):
            return None
        last, tokens = m.end(), tokens + 1
        if word not in given:
            after = _NEXT.match(text, last)
            return None if after and _is_bad(after.group(1)) else (start, last)
    # given names only so far
    before = _SURNAME_FIRST.search(text, max(0, start - 40), start)
    if before and before.start(1) >= used[0] and not _is_bad(before.group(1)):
        return before.start(1), last
    return (start, last) if tokens > 1 else None


def _is_word(token: str) -> bool:
    """Whether a capitalised word is one that is no part of a name."""
    low = _lower(token).rstrip(".")
    return low in _STATE["bad"] or low in _STATE["none"]


def _person_at(text: str, at: int) -> tuple[int, int, str, str] | None:
    """(start, end, given name, what follows it) of the name that starts at a place where one is expected."""
    m = _REVERSED.match(text, at)
    if m and not any(_is_word(w) for w in m.groups() if w) and _GOES_ON.match(text, m.end()):
        return m.start(), m.end(), m.group(2), m.group(1)
    m = _PERSON.match(text, at)
    if not m:
        return None
    words = [w for w in m.groups() if w]
    after = _NEXT.match(text, m.end())
    if any(_is_word(w) for w in words) or (after and (len(words) == 4 or _is_word(after.group(1)))) or not _GOES_ON.match(text, m.end()):
        return None
    return m.start(), m.end(), words[0], words[1]


def _expected(text: str, roles: list[tuple[int, int]], named: bool) -> list[tuple[int, int, str, str]]:
    """The names that their surroundings show, and those in a row with them."""
    out: list[tuple[int, int, str, str]] = []
    past = 0
    for s, e in roles:
        if e < past or (s and (text[s - 1].isalnum() or text[s - 1] in "_-@")):
            continue
        gap = _AFTER_ROLE.match(text, e)
        if not gap or text[e - 1].isupper() and text[s:e].islower():
            continue
        person = _person_at(text, gap.end())
        while person:
            out.append(person)
            past = person[1]
            row = _ROW.match(text, past)
            person = _person_at(text, row.end()) if row else None
    if named:
        for m in _NAMED_BEFORE.finditer(text):
            at = [k for k in (1, 2, 3) if m.group(k)]
            if len(at) == 3 and (m.group(1).isupper() and not m.group(2).isupper() or _STARTS.search(text[max(0, m.start() - 3) : m.start()]) and m.group(1) not in _STATE["given"]):
                at = at[1:]  # the end of a place in capitals, or the word that begins the sentence
            if not any(_is_word(m.group(k)) for k in at):
                out.append((m.start(at[0]), m.end(at[-1]), m.group(at[0]), m.group(at[1])))
    return out


def find(text: str, given: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """(start, end, type) of each piece of personal information, in order of place; ``given`` are the names learnt."""
    state = _state(given)
    found: list[tuple[int, int, str]] = []
    names, streets, roles = [], [], []
    at = passport = foreign = named = False
    for i, (kind, n) in state["automaton"].iter(text):
        if kind == NAME:
            s, e = i - n + 1, i + 1
            if (s == 0 or not (text[s - 1].isalnum() or text[s - 1] in "_-@.")) and (e == len(text) or not (text[e].isalnum() or text[e] in "_@")):
                names.append((s, e))
        elif kind == "street":
            streets.append(i)
        elif kind == "role":
            roles.append((i - n + 1, i + 1))
        elif kind == "named":
            named = True
        elif kind == "at":
            at = True
        elif kind == "passport":
            passport = True
        else:
            foreign = True
    if streets:
        past = 0
        for i in streets:
            if i < past:
                continue
            for m in _STREET.finditer(text, max(past, i - 70), min(len(text), i + 12)):
                if m.end() < i - 2 or m.start() < past:
                    continue
                tail = _AFTER_STREET.match(text, m.end())
                if tail:
                    quarter = _QUARTER_BEFORE.search(text, max(past, m.start() - 60), m.start())
                    found.append((quarter.start() if quarter else m.start(), tail.end(), ADDRESS))
                    past = tail.end()
                    break
    if foreign:
        found += [(*m.span(), ADDRESS) for p in (_ENGLISH, _GERMAN) for m in p.finditer(text)]
    if at:
        found += [(*m.span(), EMAIL) for m in _EMAIL.finditer(text)]
    if passport:
        found += [(*m.span(), NATIONAL_ID) for m in _PASSPORT.finditer(text) if _PASSPORT_BEFORE.search(text, max(0, m.start() - 30), m.start())]
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        if m.group("id") is None:
            found.append((s, e, PHONE))
        elif not _OTHER_NUMBER.search(text[max(0, s - 40) : s]) and not _OTHER_AFTER.match(text, e):
            found.append((s, e, NATIONAL_ID))
    if names or roles or named:
        places = sorted((s, e) for s, e, _ in found)
        starts = [s for s, _ in places]
        used = [0]

        def free(s: int, e: int) -> bool:
            k = bisect_right(starts, e - 1)
            return not k or places[k - 1][1] <= s

        for s, e in names:
            if s < used[0]:
                continue
            span = _name_at(text, s, e, used)
            if span and free(*span):
                found.append((*span, NAME))
                used[0] = span[1]
        taken = sorted((s, e) for s, e, k in found if k == NAME)
        begins = [s for s, _ in taken]
        for s, e, _, _ in _expected(text, roles, named):
            k = bisect_right(begins, e - 1)
            # a name that begins before the given name that was known is taken as a whole
            if free(s, e) and not (k and taken[k - 1][1] > s and (taken[k - 1][0] <= s or taken[k - 1][1] != e or (k > 1 and taken[k - 2][1] > s))):
                found.append((s, e, NAME))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def learn_names(df: DataFrame, text_col: str) -> tuple[str, ...]:
    """The given names of a table, in lower case: words that begin names where their surroundings show one.

    A word must do so in ``NAME_PLACES`` places and in one of ``NAME_SHARE`` of
    all, and with two followers; so at most NAME_SHARE words reach the driver.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, str], int] = {}
        automaton = _state()["automaton"]
        for t in batch.column(0).to_pylist():
            roles, named = [], False
            for i, (kind, n) in automaton.iter(t):
                if kind == "role":
                    roles.append((i - n + 1, i + 1))
                elif kind == "named":
                    named = True
            for _, _, first, then in _expected(t, roles, named):
                key = _lower(first), _lower(then)
                counts[key] = counts.get(key, 0) + 1
        first, then = zip(*counts) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(then, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["first", "then", "n"])

    rows = df.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    places = arrow_map(rows, per_batch, "first string, then string, n long").groupBy("first").agg(F.sum("n").alias("n"), F.min("then").alias("a"), F.max("then").alias("b"))
    places = materialize(places, "names")
    total = places.agg(F.sum("n")).first()[0] or 0
    common = places.where((F.col("n") >= max(NAME_PLACES, total / NAME_SHARE)) & (F.col("a") != F.col("b")))
    return tuple(sorted(r["first"] for r in common.select("first").toLocalIterator()))


def _round(key: bytes, i: int, half: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}|{n}|{half}".encode(), key=key, digest_size=16).digest(), "big")


def permute_digits(digits: str, key: bytes, rounds: int = 10) -> str:
    """A keyed permutation of the digit strings of one length, by a Feistel network with modular addition."""
    n = len(digits)
    if n < 2:
        return digits
    left, right = digits[: n // 2], digits[n // 2 :]
    for i in range(rounds):
        mixed = (int(left) + _round(key, i, right, n)) % 10 ** len(left)
        left, right = right, f"{mixed:0{len(left)}d}"
    return left + right


def _permute_within(digits: str, key: bytes, valid) -> str:
    """The permutation walked on until it is back in the format: still a permutation of the valid values."""
    out = permute_digits(digits, key)
    while not valid(out):
        out = permute_digits(out, key)
    return out


def permute_date(day: datetime.date, key: bytes) -> datetime.date:
    """A keyed permutation of the days from 1900 to 2099."""
    first = datetime.date(1900, 1, 1).toordinal()
    last = datetime.date(2099, 12, 31).toordinal()
    if not first <= day.toordinal() <= last:
        return day
    out = _permute_within(f"{day.toordinal() - first:05d}", key, lambda d: int(d) <= last - first)
    return datetime.date.fromordinal(first + int(out))


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value; equal values, however they are written, have equal ones."""
    if kind == PHONE:
        digits = re.sub(r"\D", "", value)[-10:]
        return f"[PHONE:0{_permute_within(digits, key, lambda d: d[0] in '2345')}]"
    if kind == NATIONAL_ID:
        digits = re.sub(r"\D", "", value)
        if value[0].isalpha():
            return f"[NATIONAL_ID:{value[0]}{permute_digits(digits, key)}]"
        return f"[NATIONAL_ID:{_permute_within(digits, key, lambda d: d[0] != '0')}]"
    plain = _lower(value)
    if kind == NAME:
        surname, comma, given = plain.partition(", ")
        plain = " ".join((f"{given} {surname}" if comma else plain).split())
    elif kind == EMAIL:
        plain = re.sub(r"\s", "", re.sub(r"\s?[(\[](?:at|et)[)\]]\s?", "@", re.sub(r"\s?[(\[](?:nokta|dot|punkt)[)\]]\s?", ".", plain)))
    else:
        plain = re.sub(r"[\W_]+", " ", plain)
    token = hashlib.blake2b(f"{kind}|{plain}".encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()
    return f"[{kind.upper()}:{token}]"


_DATE = re.compile(r"(?<![\w./-])(\d{1,2})([./-])(\d{1,2})\2(\d{4})(?![\w/-]|\.\d)")


def _with_dates(text: str, key: bytes) -> str:
    """A text whose days of the calendar are permuted, each in the format it is written in."""

    def other(m: re.Match) -> str:
        try:
            day = permute_date(datetime.date(int(m.group(4)), int(m.group(3)), int(m.group(1))), key)
        except ValueError:  # no day of the calendar
            return m.group()
        return f"{day.day:0{len(m.group(1))}d}{m.group(2)}{day.month:0{len(m.group(3))}d}{m.group(2)}{day.year:04d}"

    return _DATE.sub(other, text)


def pseudonyms(text: str, key: bytes, given: tuple[str, ...] = ()) -> list[tuple[int, int, str, str]]:
    """(start, end, type, placeholder) of each piece of personal information."""
    return [(s, e, kind, pseudonym(kind, text[s:e], key)) for s, e, kind in find(text, given)]


def replace(text: str, key: bytes, given: tuple[str, ...] = (), dates: bool = False) -> str:
    """A text with its personal information replaced by placeholders, otherwise unchanged; with ``dates`` these are permuted as well."""
    between = (lambda t: _with_dates(t, key)) if dates else (lambda t: t)
    out, at = [], 0
    for s, e, _, mark in pseudonyms(text, key, given):
        out += [between(text[at:s]), mark]
        at = e
    return "".join([*out, between(text[at:])])


def occurrences(df: DataFrame, id_col: str, text_col: str, key: bytes) -> DataFrame:
    """(id, pii_type, seq, pseudonym): a row for each occurrence, numbered by type in order of place, with the placeholder that links equal values."""
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    given = df.sparkSession.sparkContext.broadcast(learn_names(rows, "text"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, kinds, seqs, marks = [], [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            counts: dict[str, int] = {}
            for _, _, k, mark in pseudonyms(t, key, given.value):
                counts[k] = counts.get(k, 0) + 1
                row.append(i)
                kinds.append(k)
                seqs.append(counts[k])
                marks.append(mark)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(kinds, pa.string()), pa.array(seqs, pa.int32()), pa.array(marks, pa.string())], names=["id", "pii_type", "seq", "pseudonym"])

    return arrow_map(rows, per_batch, T.StructType([T.StructField("id", kind), T.StructField("pii_type", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("pseudonym", T.StringType())]))


def pseudonymised(df: DataFrame, text_col: str, key: bytes, out_col: str = "safe_text", dates: bool = False) -> DataFrame:
    """``df`` with the text column's personal information replaced in ``out_col``."""
    given = df.sparkSession.sparkContext.broadcast(learn_names(df, text_col))
    return add_columns(df, text_col, [T.StructField(out_col, T.StringType())], lambda texts: [pa.array([None if t is None else replace(t, key, given.value, dates) for t in texts], pa.string())])
