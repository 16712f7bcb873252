"""Secret scans by dictionary-primed zstandard novelty (operator 1).

A candidate is a run of token characters or a quoted string without blanks that begins within NEAR
characters after a cue (token, secret, password, api key ...), whatever stands between them on the line
(operators, brackets, tags, type annotations, words, blanks), or a run with a well-known key prefix.
Where words stand between, a run that isn't quoted needs a letter and a digit; where another key begins
("token": x, "name": y), the cue's reach ends.  Over line ends only signs and blanks may stand between.
From MIN_SHORT to MIN_LENGTH characters a word looks as new as a key does, so there a candidate needs
signs or digits among its letters, save for quoted values right after password and secret, and it is
measured behind a fixed lead, as a frame's own cost would hide that it is known.

Besides these, the password of a URL (scheme://user:password@host) and the body of a PEM private key are
candidates wherever they stand.

The novelty of a candidate is the number of bytes that it takes once the compressor is primed with a
dictionary of common identifiers and with the surrounding text, divided by its length.  Names, paths, words
and repeated boilerplate are found in the surroundings or the dictionary and add little; keys add about
as many bytes as they have.

Bytes that no match covers would count in full, though a word that the dictionary lacks is no more a secret
than one that it has.  So a candidate of MIN_LENGTH or more is measured a second time with a dictionary that
is trained on identifiers and prose of four languages and so has codes for their letters: a word or a
compound name takes 0.5 to 0.75 bytes a character whatever it is, random hexadecimal digits 0.8 to 1.1 and
random letters and digits 0.85 to 1.2.  Candidates with a digit need MIN_CODED, those without one
MIN_LETTERS, since random lower-case letters can't be told from an unknown name by their letters.

The surroundings are the SURROUND characters on either side without the candidate itself, so a key
that is pasted twice is still novel both times.  Reports hold a digest, not the secret.

Defined cases: null and empty texts have no findings; null ids are reported as null; texts of any length are
scanned whole; repeated rows are reported each; of overlapping candidates those in URLs and key blocks are
reported, else the one that begins first (of those that begin together, the longest); an empty table gives an empty result; other columns
are kept by redacted(), which adjusts n_chars where that is a whole number, and ignored by findings().
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common as C

MIN_LENGTH, MIN_NOVELTY, SURROUND, MASK = 16, 0.8, 1024, "<SECRET>"
MIN_SHORT, NEAR = 6, 64
MIN_CODED, MIN_LETTERS = 0.76, 0.9
PIECE = 56
CUES = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "access-key", "accesskey", "private_key", "api key", "access key", "private key", "private-key", "privatekey", "client id", "auth", "bearer", "credential", "signature", "client_id")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ", "npm_", "hf_")
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678901234567890 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX your-token-here your_api_key_here REPLACE_ME changeme "
    "example placeholder dummy sample test default undefined null none true false string number boolean object array function return import export from class public private protected static final void const let var "
    "self this new delete if else elif for while do switch case break continue try except catch finally throw raise with async await lambda yield print console log error warning info debug "
    "get set add remove create update delete read write open close start stop init load save parse format encode decode encrypt decrypt hash sign verify validate config settings options params args kwargs request response "
    "client server session user username account profile password passwd secret token access_token refresh_token id_token auth authentication authorization authenticate bearer credential credentials api_key apikey secret_key private_key public_key client_id client_secret "
    "header headers body content type application json text html http https url uri path file filename directory folder name value key index count size length width height data database table column row query select insert where order group by "
    "AccessTokenProvider TokenAuthentication TokenBucketRateLimiter PasswordResetTokenGenerator getAccessToken setAccessToken refreshAccessToken validateToken createToken SecretManager SecretsManagerClient AuthenticationManager authentication_classes "
    "process.env os.environ getenv environment variable production development staging localhost 127.0.0.1 example.com .com .org .net www. index.html README.md package.json requirements.txt node_modules src lib bin usr local home etc opt "
)
PROSE = (
    "the of and to in is that it for was on with as be at by this from have or not are but had they you which one all were we when your can said there use an each she how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde Versicherung Gesellschaft Verzeichnis Nummer Kranken Arbeit Verwaltung Wirtschaft Entwicklung Geschwindigkeit "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont mais comme ou si leur avec nous tout être cette fait gouvernement développement administration établissement "
    "que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también gobierno desarrollo administración información "
    "configuration properties bean factory context manager handler listener adapter builder provider registry controller repository service component interface implementation exception resource template message connection transaction statement iterator collection container application framework module package dependency injection annotation reflection proxy wrapper decorator visitor observer strategy command pattern bucket rate limiter version "
)
_RUN = rf"[A-Za-z0-9_\-+/=.~]{{{MIN_LENGTH},}}"
CANDIDATE = re.compile(
    rf"(?P<cue>(?i:{'|'.join(map(re.escape, CUES))}))[A-Za-z0-9_\-]{{0,24}}[\"'`]?[ \t]{{0,4}}(?:[:=]>?|(?i:is)\b)?[ \t]{{0,4}}[\"'`]?(?P<a>{_RUN})"
    rf"|(?<![A-Za-z0-9_\-])(?P<b>(?:{'|'.join(map(re.escape, PREFIXES))}){_RUN})"
)
_CUE = re.compile(rf"(?P<cue>{'|'.join(map(re.escape, CUES))})(?P<tail>[A-Za-z0-9_\-]{{0,24}})(?:[ \t]+(?:key|token|id|code|phrase)\b)?[\"'`]?", re.I)
# a value begins at a quote that follows no word (but a string prefix), or at a word's first character
_START = re.compile(r"(?:(?<!\w)|(?<=\b[bBrRuUfFL]))(?=[\"'`])|(?<![A-Za-z0-9_\-+/.~])(?=[A-Za-z0-9_\-+/.~])")
_QUOTED = re.compile(rf"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\s\\]|\\\S){{{MIN_SHORT},}})(?P=q)(?![A-Za-z0-9_])")
_BARE = re.compile(rf"[A-Za-z0-9_\-+/.~]{{{MIN_SHORT},}}={{0,2}}")
_SIGNED = re.compile(rf"(?![A-Za-z_][A-Za-z0-9_]*=(?!=*$))(?=[^\s<]{{0,64}}[A-Z])(?=[^\s<]{{0,64}}[a-z])(?=[^\s<]{{0,64}}\d)[^\s\"'`<>&;,(){{}}\[\]\\]{{{MIN_SHORT},}}")
_OTHER_KEY = re.compile(r"[,;&{}]\s*[\"'`]?(?!(?:default|value|val|data|content|text)\b)[A-Za-z_][\w\-]*[\"'`]?\s*[:=]")
_AUTHOR = re.compile(r"or(?!i[sz])", re.I)
_SHORT_KNOWN = "sha256 sha384 sha512 base64 base32 oauth2 oauth1 hs256 rs256 es256 aes128 aes256 pbkdf2 argon2 scrypt bcrypt x509 latin1 iso-8859-1 password1 password123 passw0rd admin123 12345678 abc123 foobar required optional invalid missing expired hidden "
_PRIMER = (IDENTIFIERS.upper() + IDENTIFIERS).encode()


def marginal_bytes(candidate: str, around: str) -> int:
    """Bytes that the candidate takes beyond an empty frame, given the identifiers and what surrounds it.

    It is measured in pieces, each primed with the SURROUND characters of the candidate before it: from
    about 64 literals on the compressor recodes the alphabet, which would make a long hexadecimal key
    look half known though nothing in it has been seen.
    """
    import zstandard

    total = 0
    for at in range(0, len(candidate), PIECE):
        known = _PRIMER + (around + candidate[max(0, at - SURROUND) : at]).encode("utf-8", "replace")
        c = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
        total += len(c.compress(candidate[at : at + PIECE].encode("utf-8", "replace"))) - len(c.compress(b""))
    return total


def short_bytes(candidate: str, around: str) -> int:
    """The same for a short candidate: what it adds to a lead that has literals and a match of its own."""
    import zstandard

    known = (_SHORT_KNOWN.upper() + _SHORT_KNOWN).encode() + _PRIMER + around.encode("utf-8", "replace")
    c = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    # no match is looked for in the last 8 bytes of a frame, so the candidate is followed by others
    return len(c.compress(_LEAD + candidate.encode("utf-8", "replace") + _REST)) - len(c.compress(_LEAD + _REST))


_LEAD = b"".join(bytes(range(128 + 6 * k, 134 + 6 * k - k % 3)) + w for k, w in enumerate((b"AccessTokenProvider", b"environment variable", b"node_modules", b"credential", b"undefined null", b"validateToken", b"parameter")))
_REST = bytes(range(180, 196))


_trained: list[bytes] = []


def _codes() -> bytes:
    """Dictionary with codes for the letters of identifiers and prose, once in each process; the samples are always the same."""
    if not _trained:
        import random

        import zstandard

        rnd, words = random.Random(0), (IDENTIFIERS + PROSE).split()
        samples = []
        for _ in range(1000):
            picked = [rnd.choice(words) for _ in range(18)]
            samples.append((" ".join(picked[:12]) + " " + "".join(w.title() for w in picked[12:15] if w.isalpha()) + " " + "_".join(w.lower() for w in picked[15:]) + f" {rnd.randrange(100)}").encode())
        _trained.append(zstandard.train_dictionary(1500, samples, level=19).as_bytes() + _PRIMER + PROSE.encode())
    return _trained[0]


_LETTERS_LEAD, _LETTERS_REST = b"nhutlwcdraiefmoswtnceluhdfarimcsoehtlnwduafrcmis", b"lfwumcdhsnra"


def coded_bytes(candidate: str, around: str) -> float:
    """Bytes that the candidate takes where letters cost what they cost in names and prose.

    At this level the compressor keeps the dictionary's codes for so short a text; the lead and the rest
    are letters that give the frame its size, so that the codes pay, and match nothing.
    """
    import zstandard

    total = 0
    for at in range(0, len(candidate), PIECE):
        known = _codes() + (around + candidate[max(0, at - SURROUND) : at]).encode("utf-8", "replace")
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_FULLDICT), write_content_size=False, write_checksum=False, write_dict_id=False)
        total += len(c.compress(_LETTERS_LEAD + candidate[at : at + PIECE].encode("utf-8", "replace") + _LETTERS_REST)) - len(c.compress(_LETTERS_LEAD + _LETTERS_REST))
    return total


def _as_new_as_a_key(word: str, around: str) -> bool:
    digits = any(c.isdigit() for c in word)
    least = MIN_CODED if digits else MIN_LETTERS
    if coded_bytes(word, around) < least * len(word):
        return False
    # capitals are rarer than the names in capitals are
    return digits or not word.isupper() or coded_bytes(word.lower(), around) >= least * len(word)


def _mixed(word: str) -> bool:
    """Letters with digits, or with signs that names, paths and versions don't have."""
    return any(c.isalpha() for c in word) and (any(c.isdigit() for c in word) or any(not c.isalnum() and c not in "-_./:,~<>()[]{}" for c in word))


def _near(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, cue) of the candidates after each cue, as the module's docstring has them."""
    for m in _CUE.finditer(text):
        cue, at, past = m["cue"].lower(), m.end(), m.end()
        author = cue == "auth" and _AUTHOR.match(m["tail"])
        for st in _START.finditer(text, at, min(len(text), at + NEAR)):
            s = st.start()
            if s < past:
                continue
            q = _QUOTED.match(text, s)
            gap = text[at:s]
            v = q or (re.search(r"[=:>]\s*$", gap) and _SIGNED.match(text, s)) or _BARE.match(text, s)
            if not v:
                continue
            if _OTHER_KEY.search(gap):
                break
            plain = not re.search(r"\w", re.sub(r"(?i)\bis\b|\b[bruf]$", "", gap))
            if not plain and "\n" in gap:
                break
            s, e = v.span("v") if q else (s, v.end())
            word = text[s:e] if q else text[s:e].rstrip(".=~-")
            e = s + len(word)
            if len(word) >= MIN_LENGTH:
                ok = q or plain or (any(c.isdigit() for c in word) and any(c.isalpha() for c in word))
            elif len(word) < MIN_SHORT or author:
                ok = False
            elif q:
                ok = _mixed(word) or (plain and cue in ("passw", "pwd", "secret") and any(c.isalpha() for c in word))
            else:
                ok = (plain or re.search(r"(?:[=:>(]|\b(?:is|bearer))\s*$", gap, re.I)) and any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and text[e : e + 1] not in ("(", "[")
            if ok:
                past = v.end()
                yield s, e, cue


_IN_URL = re.compile(rf"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]{{1,20}}://[^\s:@/\"'<>]{{0,64}}:(?P<v>[^\s@/\"'<>]{{{MIN_SHORT},256}})@[\w\[]")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:[A-Za-z0-9+/=\s\\:,]|-(?!-))*)")
#: Without the line ends, written out or not, around the body.
_PEM_BODY = re.compile(r"(?:\s|\\[nr])*(?P<b>.*?)(?:\s|\\[nr])*\Z", re.S)


def _structured(text: str) -> Iterator[tuple[int, int, str]]:
    """Passwords of URLs and bodies of private keys."""
    if "://" in text:
        for m in _IN_URL.finditer(text):
            yield *m.span("v"), "url"
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = _PEM_BODY.match(m["v"])
            if body and body.end("b") - body.start("b") >= MIN_LENGTH:
                yield m.start("v") + body.start("b"), m.start("v") + body.end("b"), "pem"


def _measured(text: str, s: int, e: int) -> int | None:
    """Marginal bytes of the candidate, None where it is known."""
    word = text[s:e]
    # wide enough that a copy of the candidate on the rim is seen whole, and blanked
    n, blank = SURROUND + len(word), " " * len(word)
    left, right = text[max(0, s - n) : s], text[e : e + n]
    if len(word) >= MIN_LENGTH or _mixed(word):
        left, right = left.replace(word, blank), right.replace(word, blank)
    around = left[-SURROUND:] + right[:SURROUND]
    added = marginal_bytes(word, around) if len(word) >= MIN_LENGTH else short_bytes(word, around)
    if added < MIN_NOVELTY * len(word) or (len(word) >= MIN_LENGTH and not _as_new_as_a_key(word, around)):
        return None
    return added


def scan(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, cue, marginal bytes) of every finding, in characters."""
    wide, more = dict.fromkeys(_near(text)), {}
    for m in CANDIDATE.finditer(text):
        s, e = m.span("a") if m.group("a") else m.span("b")
        word = text[s:e].rstrip(".=~-") if not m.group("b") else text[s:e].rstrip(".")
        if len(word) >= MIN_LENGTH:
            more[s, s + len(word), (m.group("cue") or "prefix").lower()] = None
    out: list[tuple[int, int, str, int]] = []
    for spans in (_structured(text), wide, more):  # a run that holds a name and its value comes after the value
        kept = sorted(out)
        for s, e, cue in sorted(spans, key=lambda x: (x[0], -x[1])):
            k = bisect.bisect_left(kept, (e,))
            if (k and kept[k - 1][1] > s) or (added := _measured(text, s, e)) is None:
                continue
            kept.insert(k, (s, e, cue, added))
        out = kept
    return out


#: Texts without any of these can hold no candidate; matched over whole Arrow arrays, in linear time.
_POSSIBLE = "(?i:" + "|".join(re.escape(c).replace("\\ ", " ") for c in CUES) + ")|" + "|".join(PREFIXES) + "|://[^\\s/@]*:[^\\s/@]*@|-----BEGIN "


def _possible(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, _POSSIBLE)


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(_possible(b.column(1)))
        rows = [(i, s, e, cue, n, hashlib.sha256(t[s:e].encode("utf-8", "replace")).hexdigest()[:16]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, cue, n in scan(t)]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.string())], names=["doc_id", "start", "end", "cue", "marginal_bytes", "digest"]
        )


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, cue, marginal_bytes, digest) of every secret."""
    C.ship(docs.sparkSession)
    return C.require(docs, "doc_id", "text").where("text is not null").mapInArrow(_scan_batches, "doc_id long, start long, end long, cue string, marginal_bytes long, digest string")


def mask(text: str) -> str:
    at, parts = 0, []
    for s, e, _, _ in scan(text):
        parts += [text[at:s], MASK]
        at = e
    return "".join(parts) + text[at:] if parts else text


def redacted(docs: DataFrame) -> DataFrame:
    """All documents and columns, every secret masked and n_chars adjusted."""
    return C.rewritten(docs, mask, _possible)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(C.read(spark, sf_dir, "documents"))
