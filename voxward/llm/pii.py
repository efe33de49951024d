"""Personal data replaced by surrogates: keyed, of the same type and form, distinct and consistent.

Detected entities get a replacement drawn by a keyed hash of their value: the
same entity has the same surrogate in the whole corpus, and different ones
differ. Draws that meet another surrogate or a real value are repeated with the
next number until none collide.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxward.llm.tables import fresh_name, small_side, stored

#: Forms of address and titles, by the gender they show (fixed values).
_FEMALE = "Mrs|Ms|Miss|Madam|Lady|Frau|Fräulein|Mme|Madame|Mlle|Mademoiselle|Señora|Señorita|Sra|Srta|Doña|Signora|Signorina|Sig\\.ra|Dra|[Гг]оспожа|[Гг]-жа|[Κκ]υρία|Κα"
_MALE = "Mr|Mister|Sir|Lord|Herrn|Herr|Monsieur|Señor|Sr|Don|Signore|Signor|Sig|[Гг]осподин|[Гг]-н|[Κκ]ύριος|[Κκ]ύριο"
_NEUTRAL = "Dr|Prof|Professor|Doctor|Doktor|Dott|Rev|Hon|Доктор|Профессор"
#: The longer of two that start alike first.
_TITLE = "|".join(sorted(f"{_FEMALE}|{_MALE}|{_NEUTRAL}".split("|"), key=len, reverse=True))
#: Tells most places from a title by one character.
_FIRST = "(?=[DFHLMPRSГгДПΚκ])"
_GAP = r"\.?[ \t\n\u00a0]{1,3}"
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PARTICLE = "von|van|vom|zu|zur|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|bin|ibn|al|el"
_NO_NAME = rf"(?i:password|passwd|secret|token|api_key|apikey)\s*[=:]|(?:{_TITLE})\b"
#: A number ends here: no letter or digit follows, nor a hyphen or point with more of the same.
_END = r"(?!\w|-\w|\.\d)"
#: What is looked for, in order of precedence; the first that matches at a place wins (fixed values of public formats).
PATTERNS = {
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:password|passwd|secret|token|api_key|apikey)\s*[=:]\s*[\"']?(?P<secret_value>[A-Za-z0-9_\-/+]{8,})",
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": rf"(?<![\w-])\d(?:[ -]?\d){{12,18}}{_END}",
    "phone": "|".join((
        r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\(\d{3}\)[ .-]?\d{7})(?!\w)",
        r"\+\d{1,3}[ .-]?\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?!\w)",
        r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,3}[ .-]\d{2,3}(?:[ .-]\d\d){2,3}(?!\w)",
        r"(?<!\w)\+\d{8,15}(?!\w)",
        r"(?<![\w+])(?<!\d/)1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
        r"(?<![\w+])(?<!\d/)\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?!\w)",
        r"(?<![\w+])(?<!\d/)0\d(?:[ .-]\d\d){4}(?!\w)",
    )),
    "person": rf"{_FIRST}(?<!\w)(?P<titles>(?:{_TITLE}){_GAP}(?:(?:{_TITLE}){_GAP})*)"
    rf"(?P<person_value>{_NAME}(?:(?: [^\W\d_]\.)* (?!{_NO_NAME})(?:(?:{_PARTICLE}) )*(?P<last>{_NAME})(?![\w%+-]|\.\w|@))?)",
}
_ALL = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
_IS_FEMALE, _IS_MALE = (re.compile(rf"(?<!\w)(?:{titles})(?!\w)") for titles in (_FEMALE, _MALE))
_ONE = {kind: re.compile(PATTERNS[kind]) for kind in ("card", "ssn", "ip", "phone")}
#: Usual groups of card numbers, longest first.
_CARD_FORMS = tuple(
    re.compile(form + _END)
    for form in (r"\d{13,19}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{6}\1\d{4,5}", r"\d{4}([ -])\d{3}\1\d{3}\1\d{3}")
)
#: A text without any of these holds no entity.
_HINT = re.compile(rf"@|\d[\d.() -]{{5}}|AKIA|ASIA|[=:]\s*[\"']?[\w/+-]{{8}}|{_FIRST}(?:{_TITLE}){_GAP}")

#: Syllables and endings of made-up names by script; the endings show the gender of given names (fixed values).
SYLLABLES = {
    "latin": "ba be da de fi ga ha jo ka ke la li lo ma me mi na ni no pa pe ra re ri ro sa se ta te ti va ve vi".split(),
    "cyrillic": "ба ве га да ди зо ка ле ли ма ми на но па ра ри ро са та ти".split(),
    "greek": "βα γε δα δι ζω κα λε λι μα μι να νο πα ρα ρι σα τα τι".split(),
}
ENDINGS = {
    ("given:f", "latin"): "na la ra", ("given:m", "latin"): "n s ro", ("family", "latin"): "ler man sen",
    ("given:f", "cyrillic"): "на ля ра", ("given:m", "cyrillic"): "н р й", ("family", "cyrillic"): "ов ин ский",
    ("given:f", "greek"): "να λα ρα", ("given:m", "greek"): "νος ρης λος", ("family", "greek"): "ίδης άκης όπουλος",
}


@dataclass(frozen=True)
class PiiParams:
    """The secret key of the surrogates."""

    key: str = "voxward"


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the entities of a text, in order, without overlap.

    Card numbers must pass the Luhn test, account numbers theirs (mod 97); where
    more digits follow, the part that passes counts. A number that precedes or
    follows does not hide another one.
    Persons are found behind a form of address or title, which may tell the
    gender; their given and family names are entities of their own. All other
    mentions of these names in the text, earlier or later, are entities too, so
    that a mention by one name alone stays the same person. Not detected are
    persons who have no title anywhere in the text, names behind other titles,
    third and later names, and bare mentions in another case, inflected or
    inside longer words. Bare names are only looked for as they are written.
    """
    if not _HINT.search(text):
        return []
    found, at, barred = [], 0, 0
    while match := _ALL.search(text, at):
        kind = match.lastgroup.removesuffix("_value")
        value = f"{kind}_value"
        start, end = match.span(value if value in _ALL.groupindex else kind)
        at = max(end, match.start() + 1)
        if kind in ("card", "iban", "phone"):
            whole = end
            if kind == "card":
                end = _card_end(text, start, end)
                if not end and any(form.match(text, start) for form in _CARD_FORMS):
                    barred = max(barred, start + 16)
                if not end and (phone := _ONE["phone"].match(text, start)):
                    kind, end = "phone", phone.end()
            elif kind == "iban":
                end = _iban_end(text, start, end)
                barred = barred if end else whole
            if end and kind == "phone" and text[start].isdigit():
                beside = bool(found) and found[-1][1] == start - 1
                joined = _joined_until(text, start, end, beside)
                barred = max(barred, joined)
                end = 0 if start < barred or not beside and _number_before(text, start, end) else end
            if end:
                found.append((start, end, kind))
                at = end
            else:
                at = start + 1
                while at < whole and text[at - 1].isalnum() and text[at].isalnum():
                    at += 1
        elif kind == "person":
            last, stop = match.span("last")
            if last >= 0 and text[last].islower():
                last, stop = -1, 0
            given = re.match(_NAME, text[start:end]).end() + start
            at = stop if last >= 0 else given
            if last >= 0:
                gender = _gender(match.group("titles"))
                found += [(start, given, gender), (last, stop, "family")]
            else:
                found.append((start, given, "family"))
        else:
            found.append((start, end, kind))
    return _with_bare_names(text, found)


def _gender(titles: str) -> str:
    """``given:f`` or ``given:m``, or ``given:`` after titles that don't tell."""
    return "given:f" if _IS_FEMALE.search(titles) else "given:m" if _IS_MALE.search(titles) else "given:"


def _with_bare_names(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The entities and all other mentions of the names among them.

    A given name whose title doesn't tell the gender has that of another mention in the text, else that of its ending.
    A word found as both given and family name is what it was first, where it stands alone.
    """
    kinds, genders = {}, {}
    for start, end, kind in found:
        if kind == "family" or kind.startswith("given"):
            name = text[start:end]
            if kind != "given:" and kind != "family":
                genders.setdefault(name, kind)
            kinds.setdefault(name, kind)
    if not kinds:
        return found
    for name, kind in kinds.items():
        if kind.startswith("given"):
            kinds[name] = genders.setdefault(name, "given:f" if name[-1] in "aаяαηά" else "given:m")
    found = [(a, b, genders.get(text[a:b]) or kinds[text[a:b]] if k == "given:" else k) for a, b, k in found]
    bare, taken = [], iter([*found, (len(text) + 1, len(text) + 1, "")])
    names = {name for name in kinds if len(name) > 1 and not name[0].islower()}
    if not names:
        return found
    a, b, _ = next(taken)
    for match in re.finditer("|".join(map(re.escape, sorted(names, key=len, reverse=True))) if len(names) <= 8 else _NAME, text):
        start, end = match.span()
        while b <= start:
            a, b, _ = next(taken)
        if end <= a and match.group() in names and _apart(text, start, end):
            bare.append((start, end, kinds[match.group()]))
    return sorted(found + bare) if bare else found


def _apart(text: str, start: int, end: int) -> bool:
    """Whether a name is a word of its own here, not a part of an address, a path or an identifier."""
    before, after = text[max(0, start - 1) : start], text[end : end + 2]
    if before.isalnum() or before in ("_", "@", "/", "\\") or after[:1].isalnum() or after[:1] in ("_", "@", "/", "\\"):
        return False
    if before == "-" and text[start - 2 : start - 1].isalpha() or after[:1] == "-" and after[1:].isupper():
        return False  # a compound name is another one
    return not (after[:1] in (".", "=", ":") and after[1:].isalnum())


def _form_end(text: str, start: int) -> int:
    """Where a valid card number in a usual form ends that starts here, or 0."""
    for form in _CARD_FORMS:
        if (match := form.match(text, start)) and _luhn(match.group()):
            return match.end()
    return 0


def _card_end(text: str, start: int, end: int) -> int:
    """Where the card number ends that starts here, or 0: usual forms first, then the whole run of digits and what is left without its last groups."""
    if usual := _form_end(text, start):
        return usual
    groups = [m.span() for m in re.finditer(r"\d+", text[start:end])]
    for k in range(len(groups), 0, -1):
        stop = start + groups[k - 1][1]
        number = text[start:stop]
        n = sum(c.isdigit() for c in number)
        if n < 13:
            return 0
        if n <= 19 and _luhn(number) and not _others_in(text, start, stop, [start + a for a, _ in groups[1:k]]):
            return stop
    return 0


def _others_in(text: str, start: int, end: int, inner: list[int]) -> bool:
    """Whether the groups of a run read better as entities of their own than as one number: a card number or others
    start inside, or a phone number, where separators differ or what follows it is another entity."""
    if any(_form_end(text, g) or _ONE["ssn"].match(text, g) or _ONE["ip"].match(text, g) for g in inner):
        return True
    if len({c for c in text[start:end] if not c.isdigit()}) > 1:
        return any(_ONE["phone"].match(text, g) for g in (start, *inner))
    phone = _ONE["phone"].match(text, start)
    return bool(phone) and any(_ONE[kind].match(text, phone.end() + 1) for kind in ("phone", "ssn", "ip"))


def _joined_until(text: str, start: int, end: int, beside: bool) -> int:
    """The end of the longer number that these groups of digits are a part of, or 0.

    Hyphens and points join what precedes; blanks only up to numbers of more than 15 digits or in groups of thousands.
    What follows an entity directly (``beside``) starts anew, and an entity that follows is not part of the number.
    """
    left = start
    if not beside and start > 1 and text[start - 2].isdigit():
        if text[start - 1] in ".-":
            return end
        if text[start - 1] == " ":
            if re.fullmatch(r"\d{3} \d{3} \d{3}", text[start:end]) and re.search(r"(?<!\d)\d{1,3} $", text[max(0, start - 5) : start]):
                return end
            left = re.search(r"(?:(?<![^\s\d])\d+ )*$", text[max(0, start - 40) : start]).start() + max(0, start - 40)
    right = end
    while right + 1 < len(text) and text[right] in " -" and (more := re.compile(r"\d+(?!\w)").match(text, right + 1)):
        if _form_end(text, right + 1) or any(_ONE[kind].match(text, right + 1) for kind in ("ssn", "ip", "phone")):
            break
        if text[right] not in text[start:end]:
            break
        right = more.end()
    return right if sum(c.isdigit() for c in text[left:right]) > 15 else 0


def _number_before(text: str, start: int, end: int) -> bool:
    """Whether the first group is a number of its own, before a phone number that takes up the rest."""
    if text[start] == "0" or re.fullmatch(r"\d{3}\D\d{3}\D\d{4}|1\D.*", text[start:end]) or re.fullmatch(r"\d+( \d{3}){2}", text[start:end]) and not re.match(r" \d{4}", text[end:]):
        return False
    second = text.find(" ", start, end)
    later = second > 0 and _ONE["phone"].match(text, second + 1)
    return bool(later) and later.end() > end and not re.compile(r"[ .-]\d").match(text, later.end())


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the account number ends that starts here, or 0: what follows it may look like more of it."""
    while end - start >= 15:
        if text[end - 1].isalnum() and not text[end : end + 1].isalnum() and _mod97(text[start:end]):
            return end
        end -= 1
    return 0


def _luhn(number: str) -> bool:
    return _luhn_sum([int(c) for c in number if c.isdigit()]) % 10 == 0


def _luhn_sum(digits: list[int]) -> int:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))


def _mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: letter case of addresses and separators of numbers don't count."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn", "iban", "phone"):
        return re.sub(r"[^\w+]", "", value)
    return value


class _Draw:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: str, kind: str, value: str, attempt: int) -> None:
        self._state = hmac.new(key.encode(), f"{kind}\0{value}\0{attempt}".encode(), "sha256").digest()
        self._n = 0

    def below(self, n: int) -> int:
        self._n += 1
        return int.from_bytes(blake2b(self._state + self._n.to_bytes(4, "little"), digest_size=16).digest()) % n

    def like(self, text: str) -> str:
        """The text with every digit and letter replaced by another of its class."""
        return "".join(
            str(self.below(10)) if c.isdigit()
            else chr(65 + self.below(26)) if "A" <= c <= "Z"
            else chr(97 + self.below(26)) if "a" <= c <= "z"
            else c
            for c in text
        )


def _script(text: str) -> str:
    for script, low, high in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ")):
        if any(low <= c <= high for c in text):
            return script
    return "latin"


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """A replacement for a canonical value, of its type and form.

    Emails keep the punctuation of their name and lie in a reserved domain, numbers keep
    their check digits, phones the start of their country code or their trunk prefix,
    addresses lie in a reserved network, secrets keep the case and kind of each
    character, names their gender and script.
    """
    draw = _Draw(key, kind, value, attempt)
    if kind == "family" or kind.startswith("given"):
        return _name(kind, _script(value), draw, attempt)
    if kind == "email":
        name, _, domain = value.partition("@")
        return f"{draw.like(name + 'x' * (attempt // 4))}@{draw.like(domain.split('.')[0])}.example.org"
    if kind == "ip":
        first = 240 + draw.below(16) if attempt < 16 else 1 + draw.below(255)
        return ".".join(map(str, (first, *(draw.below(256) for _ in range(3)))))
    if kind == "card":
        digits = value[0] + draw.like(value[1:-1])
        check = -_luhn_sum([*map(int, digits), 0]) % 10
        return f"{digits}{check}"
    if kind == "iban":
        body = draw.like(value[4:])
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "key":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in value[4:])
    if kind == "phone" and value.startswith("+"):
        return value[:2] + draw.like(value[2:])
    if kind == "phone" and (value[0] == "0" or value[0] == "1" and len(value) == 11):
        return value[0] + draw.like(value[1:])
    return draw.like(value)


def _name(kind: str, script: str, draw: _Draw, attempt: int) -> str:
    """A made-up name; later attempts are longer, so names never run out."""
    syllables, endings = SYLLABLES[script], ENDINGS[kind, script].split()
    middle = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + attempt // 2))
    return (middle + endings[draw.below(len(endings))]).capitalize()


def formatted(kind: str, value: str, replacement: str) -> str:
    """The canonical replacement in the form of this mention: separators of numbers stay where they are."""
    if kind not in ("card", "ssn", "iban", "phone"):
        return replacement
    characters = iter(replacement)
    return "".join(next(characters, "") if c.isalnum() or c == "+" else c for c in value)


def _mentions(docs: DataFrame, params: PiiParams) -> DataFrame:
    """Distinct entities of each batch with their first surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                for start, end, kind in find_entities(text or ""):
                    seen.add((kind, canonical(kind, text[start:end])))
            rows = [(kind, value, surrogate(kind, value, params.key)) for kind, value in seen]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("kind", "value", "replacement"), map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select("text").mapInArrow(run, "kind string, value string, replacement string")


def _family(kind: str) -> Column:
    return F.substring_index(kind, ":", 1)


def surrogates(docs: DataFrame, params: PiiParams = PiiParams()) -> tuple[DataFrame, DataFrame]:
    """All entities ``kind, value, replacement`` of the corpus, and those of them that needed more than one draw; stored.

    A draw stands if no other entity of its sort drew the same before, by
    smallest value, and it is nobody's real value. The others draw again
    against all that stand. Each round settles most of what is left, and the
    space of draws grows with their number, so it ends.
    """
    drawn = stored(_mentions(docs, params).distinct(), "entities")
    settled, attempt = None, 0
    values = drawn.select(_family("kind").alias("family"), F.col("value").alias("replacement"))
    redrawn = None
    while True:
        taken = values if settled is None else values.union(settled.select(_family("kind"), "replacement"))
        first = stored(drawn.groupBy(_family("kind").alias("family"), "replacement").agg(F.min(F.struct("value", "kind")).alias("low")), "draws")
        winners = (
            first.join(taken.distinct(), ["family", "replacement"], "left_anti")
            .select(F.col("low.kind").alias("kind"), F.col("low.value").alias("value"), "replacement")
        )
        good = stored(winners, "settled")
        settled = good if settled is None else settled.union(good)
        redrawn = good if attempt and redrawn is None else redrawn.union(good) if attempt else redrawn
        left = stored(drawn.select("kind", "value").join(good, ["kind", "value"], "left_anti"), "left")
        if left.isEmpty():
            break
        attempt += 1
        drawn = stored(_redrawn(left, params, attempt), "redrawn")
    return settled, redrawn if redrawn is not None else settled.limit(0)


def _redrawn(left: DataFrame, params: PiiParams, attempt: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            again = [surrogate(k, v, params.key, attempt) for k, v in zip(batch["kind"], batch["value"], strict=True)]
            yield batch.assign(replacement=again)

    return left.mapInPandas(run, "kind string, value string, replacement string")


def _texts_with_redraws(docs: DataFrame, redrawn: DataFrame) -> DataFrame:
    """By text hash ``_text`` the redrawn replacements of its entities, as a map ``_changed``; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {
                (key, kind, canonical(kind, text[start:end]))
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for start, end, kind in find_entities(text or "")
            }
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("_text", "kind", "value"), map(list, zip(*rows, strict=True)), strict=True)))

    mentions = docs.select(F.xxhash64("text").alias("_text"), "text").mapInArrow(run, "_text bigint, kind string, value string")
    entry = F.struct(F.concat("kind", F.lit("\0"), "value"), "replacement")
    return stored(
        mentions.join(redrawn, ["kind", "value"]).groupBy("_text").agg(F.map_from_entries(F.collect_set(entry)).alias("_changed")), "changed"
    )


def replace_pii(docs: DataFrame, params: PiiParams = PiiParams(), keep_entities: bool = False) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; ``n_chars``, if there, follows. Other columns stay.

    First draws are made again where the text is; only entities that needed
    another one are looked up, from a table that holds nothing else. With
    ``keep_entities`` a column ``entities`` lists ``start, end, kind, replacement``
    (places in the text as it came). Null texts stay null, repeated rows get
    equal texts, an empty table gives no rows.
    """
    _, redrawn = surrogates(docs, params)
    redrawn = stored(redrawn, "redraws")
    rest = [c for c in docs.columns if c not in ("text", "entities")]
    key, changed_at = fresh_name(docs, "text"), fresh_name(docs, "changed")
    numbered = docs.select(*rest, "text")
    if not redrawn.isEmpty():
        changed = small_side(_texts_with_redraws(docs, redrawn), 100_000).toDF(key, changed_at)
        numbered = numbered.withColumn(key, F.xxhash64("text")).join(changed, key, "left").drop(key)
    else:
        numbered = numbered.withColumn(changed_at, F.lit(None).cast("map<string,string>"))
    shape = {**{c: docs.schema[c].dataType.simpleString() for c in rest}, "text": "string"}
    if keep_entities:
        shape["entities"] = "array<struct<start:int,end:int,kind:string,replacement:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], str] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, entities = [], []
                for text, changed in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist(), strict=True):
                    changed = dict(changed or ())
                    parts, last, own = [], 0, []
                    for start, end, kind in find_entities(text or ""):
                        value = canonical(kind, text[start:end])
                        new = changed.get(f"{kind}\0{value}")
                        if new is None:
                            new = memo.get((kind, value)) or surrogate(kind, value, params.key)
                            if len(memo) < 100_000:
                                memo[kind, value] = new
                        new = formatted(kind, text[start:end], new)
                        parts += [text[last:start], new]
                        last = end
                        own.append({"start": start, "end": end, "kind": kind, "replacement": new})
                    texts.append("".join([*parts, text[last:]]) if parts else text)
                    entities.append(own)
                arrays = [batch.column(i) for i in range(len(rest))] + [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(entities, entity)] * keep_entities, list(shape))

    entity = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("replacement", pa.string())]))
    result = numbered.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in shape.items()))
    if "n_chars" in rest:
        result = result.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return result.select(*(c for c in docs.columns if c != "entities"), *["entities"] * keep_entities)
