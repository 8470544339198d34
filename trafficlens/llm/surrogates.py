"""Surrogates for personal data: keyed, consistent replacements of the same kind, script, gender and format.

Entities are found by patterns with checks: e-mail addresses, telephone numbers (international, and national ones with a
trunk zero, in North American or in Spanish groups), IPv4 addresses, payment cards and
other long account numbers, IBANs, social-security numbers, and names of persons (a title, or a given
name out of about 850 known ones with a surname). The surrogate of an entity depends on a key and on the entity alone, so one entity has one surrogate in
all documents (coreference), and a surname standing alone after a title follows the surname's surrogate.

Numbers and addresses keep their length, grouping and check digits: their free digits and letters go through a keyed
permutation of all values of that form, so two entities never share a surrogate. Names keep script, gender, capitals,
hyphens and apostrophes. A known given name becomes the next one on a keyed ring of all known names of its script and
gender. Any other name is a number among all words of its letters, goes through a keyed permutation of them, and is
spelled in syllables of its script; marks at the end keep these apart from known names and from each other. So no two
names share a surrogate, none is its own, and neither depends on the other names of a table: a table that grows keeps
its surrogates, and texts are rewritten where they lie, without a shuffle. :func:`collisions` checks all kinds.

Secrets such as keys and passwords identify no person and are left alone.

Defined results: a null text stays null and an empty one empty; texts without entities come back unchanged to the
byte; repeated rows get equal results; an empty table gives no rows; extra columns are kept, clashing ones included,
because only ``text`` is replaced and two columns are added under given names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sofia Emma Clara Elena Sarah Lucia Alice Nina Eva Marta Irene Paula Helen Ruth Diana Carla".split(),
    ("latin", "m"): "Peter Paul Martin Thomas David Daniel Lucas Simon Robert Victor Anton Hugo Felix Oscar Julian Walter Henry Mark Leon Adam".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия Вера Нина".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Павел Виктор Олег Юрий".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Δήμητρα Ιωάννα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος Ανδρέας Πέτρος".split(),
}
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "", "Doctor": "", "Doktor": "", "Docteur": "", "Doctora": "f", "Prof": "", "Professor": "", "Professorin": "f", "Professeur": "", "Profesor": "m", "Profesora": "f",
}
# Further given names that are recognised.
KNOWN = {
    "f": (
        "Abigail Adele Adelheid Adriana Agathe Agnes Aimée Alba Alejandra Alexandra Alicia Alina Alison Amalia Amanda Amber Amelia Amélie Amy Ana Andrea Angela Angelika Angélique Anita Anja "
        "Anke Anne Annette Annie Antje Antonia Ariane Ashley Astrid Audrey Aurélie Aurora Ava Barbara Beate Beatrice Beatriz Béatrice Begoña Belén Bettina Betty Birgit Blanca Brenda Brigitte "
        "Britta Camila Camille Candela Carina Carla Carmen Carol Carolina Caroline Catherine Cécile Céline Chantal Charlotte Chloe Chloé Christa Christelle Christiane Christina Christine Cindy "
        "Claire Clara Claudia Claudine Colette Concepción Constanze Consuelo Corinna Corinne Cornelia Cristina Cynthia Dagmar Daniela Danielle Deborah Delphine Denise Diane Dolores Donna Dora "
        "Doris Dorothea Dorothy Edith Eileen Elena Elfriede Élodie Élise Elisa Elisabeth Elizabeth Elke Ella Ellen Elsa Elvira Emilia Emily Émilie Emmanuelle Encarnación Erika Esperanza Esther "
        "Eugénie Eva Évelyne Evelyn Fabienne Fatima Florence Franziska Françoise Frieda Gabriela Gabriele Gabrielle Geneviève Gerda Gertrud Ghislaine Gisela Gisèle Gloria Greta Gudrun Guadalupe Hannah "
        "Hanna Heather Heidi Heike Helena Helga Hélène Henriette Hilde Hildegard Ida Ilse Inés Inès Inge Ingeborg Ingrid Irina Irma Isabel Isabella Isabelle Jacqueline Jana Jane Janet Janice Jasmin "
        "Jeanne Jennifer Jenny Jessica Jimena Joan Joanna Johanna Josefa Josefina Josephine Joséphine Juana Judith Julie Juliette Jutta Karen Karin Karla Katarina Katharina Katherine Kathleen Kathrin "
        "Katja Katrin Kelly Kerstin Kimberly Kirsten Klara Kristin Lara Laetitia Laure Lauren Laurence Lea Léa Leonie Leonor Leticia Lina Linda Lisa Lola Lorena Louise Lourdes Lucía Lucie Luise Luisa Luz "
        "Lydia Lydie Madeleine Magali Magdalena Maite Manon Manuela Mareike Margaret Margarethe Margarita Margot Marguerite María Mariana Marianne Marie Marina Marion Marisol Marlene Martha Martina Martine "
        "Mary Mathilde Matilda Maureen Megan Melanie Mélanie Melissa Mercedes Mia Michaela Michelle Michèle Mireille Miriam Mona Monica Mónica Monika Monique Montserrat Muriel Nadia Nadine Nancy Natalia "
        "Natalie Nathalie Nicola Nicole Noelia Nora Nuria Odette Odile Olga Olivia Pamela Pascale Patricia Paulina Pauline Petra Pia Pilar Priscilla Rachel Raquel Rebecca Regina Regine Renate Renée Rita "
        "Roberta Rocío Rosa Rosalía Rosario Rosemarie Roswitha Sabine Sabrina Samantha Sandra Sandrine Sara Sharon Shirley Sibylle Sigrid Silke Silvia Simone Solange Sonia Sonja Sophia Sophie Stefanie "
        "Stephanie Stéphanie Susan Susana Susanna Susanne Suzanne Svenja Sylvia Sylvie Tamara Tanja Tatiana Teresa Thérèse Theresa Tina Ulrike Ursula Ute Valentina Valérie Vanessa Vera Verena Verónica "
        "Veronica Véronique Victoria Viktoria Violeta Virginia Virginie Viviane Waltraud Wendy Wilma Ximena Yolanda Yvette Yvonne Zoe Zoé"
    ).split(),
    "m": (
        "Aaron Adolf Adrián Adrian Adrien Agustín Alain Alan Albert Alberto Albrecht Alejandro Alex Alexander Alexandre Alexis Alfonso Alfred Alfredo Álvaro Andreas Andrés André Andrew Ángel Anthony Antoine "
        "Antonio Armando Armin Arnaud Arthur Arturo Arnold Aurélien Axel Baptiste Bastien Benedikt Benito Benjamin Benjamín Benoît Bernardo Bernd Bernhard Bertrand Bobby Boris Brandon Brian Bruce Bruno Bryan Carl "
        "Carlos Cédric César Charles Christian Christoph Christophe Christopher Claude Clemens Clément Craig Cristian Cyril Damián Damien Daniele Dean Denis Dennis Detlef Didier Diego Dieter Dietmar Dirk Domingo Dominik "
        "Dominique Donald Douglas Dylan Eberhard Eckhard Edgar Édouard Eduard Eduardo Edward Edwin Elias Emil Émile Emilio Emmanuel Enrique Eric Éric Erich Erik Ernesto Erwin Esteban Étienne Eugen Eugène Eugenio Ethan Fabian Fabián Fabien "
        "Fabio Federico Felipe Ferdinand Fernand Fernando Florian Francis Francisco François Frank Franz Fred Frédéric Frederick Friedrich Fritz Gabriel Gary Gaston Georg George Georges Gérard Gerald Gerardo Gerd Gerhard Germán Gilbert Gilles "
        "Gonzalo Gregor Gregory Grégory Guido Guillaume Guillermo Günter Günther Gustav Gustavo Guy Hannes Hans Harald Harold Harry Hartmut Hector Héctor Heinrich Heinz Helmut Henri Hermann Herbert Holger Horst Howard Hubert Ian Ignacio "
        "Ingo Isaac Ismael Iván Jack Jacob Jacques Jaime Jakob James Jan Jason Javier Jean Jeffrey Jens Jeremy Jérémy Jérôme Jerry Jesse Jesús Jim Joachim Joaquín Jochen Joe Joël Johann Johannes John Johnny Jonas Jonathan Jörg Jordi Jorge José "
        "Josef Joseph Joshua Juan Jules Julien Julio Jürgen Justin Kai Karl Karsten Keith Kenneth Kevin Klaus Konrad Kurt Kyle Larry Lars Laurent Lawrence Leonard Leonardo Leopold Lionel Lorenzo Lothar Louis Loïc Lorenz Luc Luca Lucien Ludovic Ludwig Luis Lukas Lutz "
        "Manfred Manuel Marc Marcel Marcelo Marco Marcos Mariano Mario Marius Markus Marvin Mateo Mathias Mathieu Mathis Matthew Matthias Matthieu Maurice Mauricio Max Maxime Maximilian Michael Michel Miguel Moritz Nathan Nicholas Nicolas Nicolás Niklas Nils Noah Norbert Norman "
        "Olaf Oliver Olivier Omar Óscar Oskar Oswald Otto Pablo Pascal Patrice Patrick Paulo Pedro Philip Philipp Philippe Pierre Quentin Rafael Rainer Ralf Ralph Ramón Randy Raoul Raphael Raphaël Raúl Raymond Reiner Reinhard Reinhold Rémi Rémy René Ricardo Richard Roberto Rodolfo Rodrigo "
        "Roger Roland Rolf Roman Romain Ronald Ruben Rubén Rudolf Rüdiger Russell Ryan Salvador Samuel Santiago Scott Sean Sébastien Sebastian Sebastián Sergio Serge Siegfried Sigmund Stanley Stefan Stephan Stéphane Stephen Steven Steve Sven Sylvain Terry Théo Theodor Thibault Thierry Thilo "
        "Thorsten Till Tim Timothy Tobias Tomás Torsten Tristan Tyler Udo Ulrich Uwe Valentin Vicente Vincent Volker Walther Werner Wilfried Wilhelm William Wolfgang Xavier Yann Yannick Yves Zachary"
    ).split(),
}
GENDER = {n: g for g, names in KNOWN.items() for n in names} | {n: g for (_, g), names in GIVEN.items() for n in names}

# Letters of a script: those of most names, then rarer ones.
LETTERS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœšž"),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "ѐђѓєѕіїјљњћќѝўџґ"),
    "greek": ("αβγδεζηθικλμνξοπρσςτυφχψω", "άέήίόύώϊϋΐΰ"),
}
# Syllables: consonants of the first and of later syllables, and vowels of the first syllable by how rare the letters
# of the name are, so that these three never spell the same.
FIRST = {
    "latin": "b d f g h k l m n p r s t v w br dr fr gr kr tr bl fl gl kl pl st".split(),
    "cyrillic": "б в г д ж з к л м н п р с т ф х бр гр др кр тр ст".split(),
    "greek": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ κρ πρ τρ στ".split(),
}
LATER = {
    "latin": "b d f g k l m n p r s t v ll mm nn rr ss tt ld lm nd nt rd rg rk rl rm rn rt st lk mb mp ng nk sk tz ck lb rb ff gn".split(),
    "cyrillic": "б в г д ж з к л м н п р с т ч ш лл нн нк нд рк рт рм лк лд ст ск мб".split(),
    "greek": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ λλ νν σσ ντ ρκ ρμ στ λδ νδ".split(),
}
VOWELS = {
    "latin": ("a e i o u".split(), "ä ö ü é á".split(), "ia io ua ie eo".split()),
    "cyrillic": ("а е и о у".split(), "я ё ю э ы".split(), "иа ио уа еа оа".split()),
    "greek": ("α ε ι ο ω".split(), "ά έ ί ό ώ".split(), "ια ιο ωα εα οα".split()),
}
# How a made-up name ends; those of given names end no known one. ``EXTRA`` follows a word that would spell itself.
ENDS = {
    ("latin", ""): ["", "n", "r", "l", "s", "t", "ck", "rd"], ("latin", "f"): ["lva", "rga", "nka", "rva"], ("latin", "m"): ["lv", "rv", "sk", "lk"],
    ("cyrillic", ""): ["", "в", "к", "н", "й", "р"], ("cyrillic", "f"): ["лва", "рга", "нка", "рва"], ("cyrillic", "m"): ["лв", "рв", "ск", "лк"],
    ("greek", ""): ["", "ς"], ("greek", "f"): ["λβα", "ργα", "νκα", "ρβα"], ("greek", "m"): ["λβος", "ργος", "νκος", "ρβος"],
}
EXTRA = {"latin": "mpf", "cyrillic": "щ", "greek": "ξ"}

# a capitalised word without a possessive ending
CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ](?:[\w-]|[’'](?!s(?!\w)))*[a-zß-öø-ÿа-яёα-ωά-ώ]"
ANY_TITLE = "|".join(TITLES)
ANY_GIVEN = rf"(?:{'|'.join(GENDER)})(?:-{CAPITAL})?"
DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d)"
NEXT = r"(?! 0(?:\d{1,4}[ /-]\d{5}|[1-9](?: \d\d){4}))"  # another number begins here
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w@])"),
    "iban": re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w.])(?:"
        r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\d{3}[ .-]\d{3}[ .-]\d{4})"
        r"|\+\d{8,15}"
        rf"|(?:\+|00)[1-9]\d{{0,2}}(?:[ ./-]?\(\d{{1,5}}\)[ ./-]?\d{{1,8}}|[ ./-]\d{{1,8}})(?:{NEXT}[ ./-]\d{{1,8}}){{0,6}}"  # country code and groups
        rf"|(?!{DATE})(?:\(0[1-9]\d{{0,4}}\)[ ./-]?|0[1-9]\d{{0,4}}[ ./-])\d{{2,8}}(?:{NEXT}[ .-]\d{{2,4}}){{0,5}}"  # trunk zero and groups
        r"|00?[1-9]\d{8,12}"
        r"|[6-9]\d{2}(?:(?:[ .-]\d{2}){3}|(?:[ -]\d{3}){2})"  # Spanish, which have no trunk zero
        r")(?!\w)"
    ),
    "person": re.compile(
        rf"(?<!\w)(?=[^\W\d_a-z])(?:(?P<title>{ANY_TITLE})(?:\.? (?:{ANY_TITLE})(?=[. ]))*\.? (?P<after>(?:{ANY_GIVEN} )*{CAPITAL}(?: {CAPITAL})?)"
        rf"|(?P<given>{ANY_GIVEN})(?: {ANY_GIVEN}(?= {CAPITAL}))* (?P<family>{CAPITAL}))(?!\w)"
    ),
}


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def luhn_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def valid_iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and iban_number(t[4:] + t[:4]) % 97 == 1


def telephone(text: str) -> str:
    """The part of a match that is a telephone number: whole groups up to 15 digits; empty if that is no number.

    Seven digits at least, and ten where no group has more than two, as in times and in lists of numbers.
    """
    groups = list(re.finditer(r"\d+", text))
    while sum(len(g.group()) for g in groups) > 15:
        groups.pop()
    longest = max((len(g.group()) for g in groups), default=0)
    least = 10 if longest <= 2 and not text.startswith("+") else 7
    return text[: groups[-1].end()] if sum(len(g.group()) for g in groups) >= least else ""


def dialled(text: str, at: int, entity: str) -> bool:
    """Whether what looks like an account number is a telephone number: after a plus, or in groups with a trunk zero."""
    if text[at - 1 : at] == "+":
        return PATTERNS["phone"].match(text, at - 1) is not None
    m = None if entity.isdigit() or entity[0] != "0" else PATTERNS["phone"].match(text, at)
    return m is not None and telephone(m.group()) == m.group()


def kept_digits(entity: str, digits: str) -> int:
    """How many leading digits of a telephone number stay: the country code, or trunk zeros and the digit after them."""
    if entity.startswith("+"):
        return len(re.match(r"\+?\d{1,3}(?=[ ./(-])|", entity).group().lstrip("+"))
    if re.match(r"00[1-9]\d{0,2}[ ./(-]", entity):
        return len(re.match(r"\d+", entity).group())
    if digits.startswith("0"):
        return len(digits) - len(digits.lstrip("0")) + 1
    return 0 if re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", entity) or entity.startswith("(") else 1


def script_of(text: str) -> str:
    first = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def keyed(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permuted(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: four or more rounds of alternating modular addition, walked into range."""
    if size < 2:
        return value
    a = 1 << ((size - 1).bit_length() + 1) // 2
    b = 1 << ((size - 1).bit_length()) // 2
    while True:
        left, right = divmod(value, b)
        for r in range(8):
            if r % 2:
                left = (left + keyed(key, label, size, r, right)) % a
            else:
                right = (right + keyed(key, label, size, r, left)) % b
        value = left * b + right
        if value < size:
            return value


def permuted_digits(key: bytes, label: str, digits: str) -> str:
    """Another number of the same length; lengths of one digit change too."""
    size = 10 ** len(digits)
    value = permuted(key, label, int(digits), size)
    return str(value).zfill(len(digits))


def refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def formed_surrogate(key: bytes, kind: str, entity: str) -> str:
    """Surrogate of an entity with a form: a permutation on all entities of that form."""
    digits = "".join(c for c in entity if c.isdigit())
    if kind == "card":
        if luhn(digits):
            body = digits[0] + permuted_digits(key, f"card{digits[0]}", digits[1:-1])
            return refilled(entity, body + luhn_digit(body))
        return refilled(entity, digits[0] + unlike(key, f"account{digits[0]}", digits[0], digits[1:]))
    if kind == "ip":
        return ip_surrogate(key, entity)
    if kind == "email":
        name, _, host = entity.rpartition("@")
        labels, _, top = host.rpartition(".")
        return f"{reshaped(key, 'mail', name)}@{reshaped(key, 'host', labels)}.{top}"
    if kind == "iban":
        t = entity.replace(" ", "")
        body = reshaped(key, f"iban{t[:2]}", t[4:])
        check = f"{98 - iban_number(body + t[:2] + '00') % 97:02d}"
        new = iter(t[:2] + check + body)
        return "".join(c if c == " " else next(new) for c in entity)
    if kind == "phone":
        keep = kept_digits(entity, digits)
        return refilled(entity, digits[:keep] + permuted_digits(key, f"phone{digits[:keep]}", digits[keep:]))
    return refilled(entity, permuted_digits(key, kind, digits))


def unlike(key: bytes, label: str, head: str, digits: str) -> str:
    """The permutation restricted to numbers that fail the card check, so that a failing number stays one."""
    new = permuted_digits(key, label, digits)
    while luhn(head + new):
        new = permuted_digits(key, label, new)
    return new


def ip_surrogate(key: bytes, entity: str) -> str:
    """Another address of the same kind (private stays private, public public); parts stay within 0 .. 255."""
    import ipaddress

    def private(v: int) -> bool:
        return ipaddress.IPv4Address(v).is_private

    value = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in entity.split("."))))
    was = private(value)
    new = permuted(key, "ip", value, 1 << 32)
    while private(new) != was:
        new = permuted(key, "ip", new, 1 << 32)
    return str(ipaddress.IPv4Address(new))


def permuted_letters(key: bytes, label: str, letters: str) -> str:
    """Another string of as many letters A-Z."""
    number = 0
    for c in letters:
        number = number * 26 + ord(c) - 65
    number = permuted(key, f"{label}/{len(letters)}", number, 26 ** len(letters))
    out = []
    for _ in letters:
        number, r = divmod(number, 26)
        out.append(chr(65 + r))
    return "".join(reversed(out))


def reshaped(key: bytes, label: str, text: str) -> str:
    """Letters to letters and digits to digits, as permutations over all texts of the same shape; case stays."""
    plain = text.upper()
    shape = "".join("A" if "A" <= c <= "Z" else "0" if c.isdigit() else c for c in plain)
    letters = "".join(c for c, k in zip(plain, shape, strict=True) if k == "A")
    digits = "".join(c for c, k in zip(plain, shape, strict=True) if k == "0")
    new_letters = iter(permuted_letters(key, f"{label}/{shape}", letters))
    new_digits = iter(permuted_digits(key, f"{label}/{shape}", digits) if digits else "")
    out = [next(new_letters) if k == "A" else next(new_digits) if k == "0" else c for c, k in zip(plain, shape, strict=True)]
    return "".join(n.lower() if c.islower() else n for c, n in zip(text, out, strict=True))


def found(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities of a text as (start, end, kind, entity), left to right without overlaps; earlier kinds win."""
    if not text:
        return []
    has_digit = any(c.isdigit() for c in text)
    spans: list[tuple[int, int, str, str]] = []
    for kind, pattern in PATTERNS.items():
        if kind != "person" and not has_digit and kind != "email" or kind == "email" and "@" not in text:
            continue
        at = 0
        while m := pattern.search(text, at):
            entity, a, b = m.group(), m.start(), m.end()
            at = b
            if kind == "phone":
                entity = telephone(entity)
                if not entity:
                    continue
                at = b = a + len(entity)
            if kind == "person":
                group = "after" if m["title"] else "given"
                a = m.start(group)
                entity = text[a:b]
            if kind == "ip" and any(int(p) > 255 for p in entity.split(".")):
                continue
            if kind == "iban" and not valid_iban(entity):
                continue
            if kind == "card" and dialled(text, a, entity):
                continue
            if kind == "card" and not 13 <= sum(map(str.isdigit, entity)) <= 19:
                continue
            if any(x < b and a < y for x, y, _, _ in spans):
                continue
            gender = ("title" in m.groupdict() and m["title"] and TITLES[m["title"]]) or GENDER.get(re.split("[ -]", entity)[0], "") if kind == "person" else ""
            spans.append((a, b, kind if not gender else f"person-{gender}", entity))
    return sorted(spans)


def parts_of(kind: str, entity: str) -> list[tuple[str, str]]:
    """The names of a person as (pool, name), each with its own surrogate, so that a surname alone follows."""
    names, gender = entity.split(" "), kind.rpartition("-")[2] if "-" in kind else "m"
    script = script_of(entity)
    if len(names) == 1 and names[0] not in GENDER:
        return [(f"surname-{script}", names[0])]
    rest = [(f"surname-{script}", names[-1])] if len(names) > 1 else []
    given = names[:-1] or names
    return [*[(f"given-{script}-{GENDER.get(n.partition('-')[0], gender)}", n) for n in given], *rest]


@cache
def ring(key: bytes, script: str, gender: str) -> dict[str, str]:
    """Each known given name of a script and gender, and the next one in a keyed order."""
    names = sorted((n for n, g in GENDER.items() if g == gender and script_of(n) == script), key=lambda n: keyed(key, "ring", n))
    return dict(zip(names, names[1:] + names[:1], strict=True))


def spelled(script: str, gender: str, rarity: int, number: int) -> str:
    """The ``number``-th word of syllables; another number gives another word."""
    first, later, vowels, ends = FIRST[script], LATER[script], VOWELS[script], ENDS[script, gender]
    size, more = len(first) * len(vowels[rarity]) * len(ends), 0
    while number >= size:
        number -= size
        size *= len(later) * len(vowels[0])
        more += 1
    number, e = divmod(number, len(ends))
    inner = []
    for _ in range(more):
        number, r = divmod(number, len(later) * len(vowels[0]))
        c, v = divmod(r, len(vowels[0]))
        inner.append(later[c] + vowels[0][v])
    c, v = divmod(number, len(vowels[rarity]))
    return "".join([first[c] + vowels[rarity][v], *inner, ends[e]])


def made_up(key: bytes, script: str, gender: str, word: str) -> str:
    """Surrogate of a word in lower case: its number among all words of its letters, permuted and spelled."""
    usual, rarer = LETTERS[script]
    rarity = 0 if all(c in usual for c in word) else 1 if all(c in usual or c in rarer for c in word) else 2
    letters = usual if rarity == 0 else usual + rarer
    base = 0x110000 if rarity == 2 else len(letters)
    number = shorter = 0
    for k, c in enumerate(word):
        number = number * base + (ord(c) if rarity == 2 else letters.index(c))
        shorter += base**k if k else 0
    new = spelled(script, gender, rarity, shorter + permuted(key, f"name/{script}/{gender}/{rarity}", number, base ** len(word)))
    return new + EXTRA[script] if new == word else new


@lru_cache(maxsize=1 << 16)
def name_surrogate(key: bytes, pool: str, name: str) -> str:
    """Surrogate of one name: word by word (a word begins at a capital), with what stands between kept."""
    kind, script, *rest = pool.split("-")
    gender = rest[0] if rest else ""
    known = ring(key, script, gender) if kind == "given" else {}

    def word(m: re.Match[str]) -> str:
        old = m.group()
        if old in known:
            return known[old]
        plain = old[0].lower() + old[1:]
        # a capital without one lower letter that leads back to it is spelled as it is
        new = made_up(key, script, gender, plain if len(plain) == len(old) and plain[0].upper() == old[0] or old[0].islower() else old)
        return new[0].upper() + new[1:] if old[0].isupper() else new

    return WORD.sub(word, name)


WORD = re.compile(r"[^\W\d_](?:(?![A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ])[^\W\d_])*")


def surrogate(key: bytes, kind: str, entity: str) -> str:
    """Surrogate of any entity, by the key and the entity alone."""
    if kind.startswith("person"):
        return " ".join(name_surrogate(key, *part) for part in parts_of(kind, entity))
    return formed_surrogate(key, kind, entity)


def rewritten(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds of its entities in order."""
    spans = found(text)
    if not spans:
        return text, []
    out, last = [], 0
    for a, b, kind, entity in spans:
        out += [text[last:a], surrogate(key, kind, entity)]
        last = b
    return "".join([*out, text[last:]]), [kind.partition("-")[0] for _, _, kind, _ in spans]


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, ``n_entities`` and ``kinds`` (of the entities, in order of place) added."""

    @F.pandas_udf("struct<text: string, kinds: array<string>>")
    def rewrite(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewritten(t, key) for t in text], columns=["text", "kinds"])

    done = docs.withColumn("__done", rewrite(text_col))
    columns = [F.col("__done.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_entities", "kinds")]
    return done.select(*columns, F.size("__done.kinds").alias("n_entities"), F.col("__done.kinds").alias("kinds"))


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, entities) of surrogates shared by several entities, names one by one: empty, as none is shared."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = set()
            for t in frame["text"]:
                for _, _, kind, e in found(t):
                    if kind.startswith("person"):
                        seen.update((pool, n, name_surrogate(key, pool, n)) for pool, n in parts_of(kind, e))
                    else:
                        seen.add((kind, e.lower() if kind == "email" else e, formed_surrogate(key, kind, e.lower() if kind == "email" else e)))
            yield pd.DataFrame(sorted(seen), columns=["kind", "entity", "surrogate"])

    pairs = docs.select(F.col(text_col).alias("text")).mapInPandas(look, "kind string, entity string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities")).where("entities > 1")
