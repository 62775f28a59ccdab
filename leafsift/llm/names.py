"""Normal forms of freely typed names, for comparison only."""

from __future__ import annotations

import re
import unicodedata

# What people write around a name. Prefixes, then endings, each removed while it fits.
PREFIXES = (
    r"fabricado por", r"fabricante", r"fab\.? ?por", r"produzido por", r"distribuido por", r"nome comercial", r"nome", r"marca",
)
ENDINGS = (
    r"\(?(?:matriz|filial(?: n?\d+)?)\)?", r"(?:unid|unidade)\.? ?\d*", r"caixa (?:c/?|com) ?\d+", r"cx\.? ?(?:c/?)? ?\d+",
    r"\d+(?:[.,]\d+)? ?(?:mg|ml|g|mcg|ui)(?: ?/ ?\d* ?(?:mg|ml|g|mcg|ui))?", r"comp\.?(?: rev\.?)?", r"comprimidos?", r"rev\.?",
    r"gotas", r"capsulas?", r"\(?referencia\)?", r"\(?generico\)?", r"caps\.?", r"xarope", r"pomada", r"\(r\)", r"\(tm\)", r"\((?:br|brasil|[a-z]{2})\)",
)
# Words of legal form and trade, as written out and as abbreviated.
TRADE_WORDS = (
    "laboratorios", "laboratorio", "lab", "labs", "instituto", "inst", "companhia", "cia", "comp", "industria", "ind", "industrias",
    "quimica", "quim", "farmaceutica", "farmaceuticos", "farm", "produtos", "prod", "hospitalares", "hosp", "medicamentos", "med",
    "biofarmacos", "biof", "ltda", "me", "epp", "eireli", "sa", "s", "a", "de", "e", "do", "da", "dos", "das",
)
# What is written where there is no name.
PLACEHOLDERS = (
    "", "na", "nd", "ni", "nc", "null", "none", "nao informado", "nao informada", "nao consta", "nao se aplica", "sem informacao",
    "sem nome", "sem marca", "desconhecido", "desconhecida", "a definir", "a confirmar", "generico", "teste", "xxx", "x", "diversos", "varios", "vide bula", "ver bula",
    "outro", "outros", "ignorado", "nenhum", "nenhuma", "nao ha", "sem fabricante", "fabricante", "marca", "nome",
)
_PRE = re.compile(r"^(?:%s)\b[ .:]*" % "|".join(PREFIXES))
_END = re.compile(r"(?:^|[\s\-/,;.*(])+(?:%s)[\s\-/,;.*)]*$" % "|".join(ENDINGS))
_HIDDEN = re.compile("[​-‏‪-‮⁠﻿­®™©ªº]")
_BROKEN = re.compile("[ÃÂâ][\x80-\xbfŒœŠšŸŽžƒˆ˜–-›€™]")
_LEGAL = re.compile(r"\bs ?[./] ?a\b\.?")
_SOUNDS = (("ch", "x"), ("ph", "f"), ("y", "i"), ("k", "c"), ("w", "v"), ("z", "s"), ("j", "g"), ("ss", "s"))
_DIGITS = str.maketrans("01356", "olesb")


def mended(s: str) -> str:
    """UTF-8 read as a one-byte encoding, put right where that is what it is."""
    for _ in range(2):
        if not _BROKEN.search(s):
            break
        for enc in ("cp1252", "latin-1"):
            try:
                s = s.encode(enc).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            s = re.sub("[\xc3\xc2\xe2][\x80-\xbf€™–-›]+", lambda m: _mend(m.group()), s)
    return s


def _mend(part: str) -> str:
    raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252", "ignore") for c in part)
    return raw.decode("utf-8", "ignore")


def plain(s: str) -> str:
    """Lower case, no accents, no hidden characters, single spaces."""
    s = _HIDDEN.sub("", mended(s))
    s = unicodedata.normalize("NFKD", s).casefold()
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.sub(r"[\s\"'“”‘’]+", " ", s).strip()


def bare(s: str) -> str:
    """``plain`` without what is written around a name."""
    s = plain(s).strip(" .,;:-*/")
    while True:
        t = _PRE.sub("", s, count=1)
        t = _END.sub("", t).strip(" .,;:-*/")
        if t == s or not t:
            return t or s
        s = t


def core(s: str, trade: bool) -> str:
    """The letters of the name proper, run together and folded by sound."""
    s = bare(s)
    if trade:
        s = _LEGAL.sub(" ", s)
        ws = [w for w in re.split(r"[^a-z0-9\-]+", s) if w]
        kept = [w for w in ws if w.strip("-") not in TRADE_WORDS]
        s = "".join(kept)
    s = re.sub(r"[^a-z0-9]", "", s)
    return sounded(s)


def sounded(s: str) -> str:
    if re.search("[a-z]", s):
        s = s.translate(_DIGITS)
    for a, b in _SOUNDS:
        s = s.replace(a, b)
    s = re.sub(r"c(?=[ei])", "s", s)
    return re.sub(r"(.)\1+", r"\1", s)


def letters(s: str) -> str:
    """All letters and digits of the plain form; for abbreviations."""
    return re.sub(r"[^a-z0-9]", "", bare(s))


def placeholder(s: str) -> bool:
    b = re.sub(r"[^a-z0-9 ]", "", plain(s)).strip()
    return b in PLACEHOLDERS or not re.search(r"[a-z]", b)
