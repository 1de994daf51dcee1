r"""Character classes and chat-export patterns.

Every pattern is written once, without flags, so that it can be used both by
Spark (Java regex) and by the SQL checks (RE2).  Case-insensitive matching is
added by the caller: ``(?iu)`` / ``(?iU)`` in Java, ``(?i)`` in RE2.
"""

from __future__ import annotations

# The characters str.strip() removes and str.split() splits on.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# --- fixed values -----------------------------------------------------------

# Control characters dropped from raw text; tab, LF and CR stay.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# Line ends other than LF that split a text into lines.
OTHER_LINE_ENDS = r"\r\n|\r|\x{85}|\x{2028}|\x{2029}"

# Whitespace as a character-class body (no brackets).
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# A line opening with this starts a new message.
MESSAGE_PREFIX = (
    r"(?:\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4}[,%s]|\[\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4})" % SPACE
)

# "12/01/2024, 08:15 - Author: Message"; groups: day, month, year, hour,
# minute, second, AM/PM, author, message.
ANDROID_LINE = (
    r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4}),[%(s)s]"
    r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:[%(s)s]?([AP]M))?[%(s)s]-[%(s)s]"
    r"([^:]+):[%(s)s](.+)" % {"s": SPACE}
)

# "[12/01/2024 à 08:15:00] Author : Message"; groups: day, month, year, hour,
# minute, second, author, message.
IOS_LINE = (
    r"\[([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})[,%(s)sà]+"
    r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\][%(s)s]"
    r"([^:]+)[%(s)s]?:[%(s)s](.+)" % {"s": SPACE}
)

# A message containing one of these is 'media'.
MEDIA_NOTICES = [
    r"<media omitted>",
    r"média omis",
    r"image omitted",
    r"video omitted",
    r"audio omitted",
    r"sticker omitted",
    r"document omitted",
    r"gif omitted",
]

# A message containing one of these (and no media notice) is 'system'.
# \b is a word edge in the Unicode sense.
SYSTEM_NOTICES = [
    # encryption
    r"messages and calls are end-to-end encrypted",
    r"les messages et les appels sont chiffrés de bout en bout",
    r"tap to learn more",
    r"appuyez pour en savoir plus",
    # deleted messages
    r"this message was deleted",
    r"ce message a été supprimé",
    r"message deleted",
    r"message supprimé",
    # membership and group changes, French
    r"\ba ajouté\b",
    r"\ba quitté\b",
    r"\ba été supprimée?\b",
    r"\ba supprimé\b",
    r"\ba rejoint\b",
    r"\ba créé (?:le )?groupe",
    r"\bont été ajoutée?s?\b",
    r"\bavez (?:été ajouté|rejoint)\b",
    r"\ba changé (?:le nom|l'intitulé|l'icône) du groupe",
    r"\ba modifié la description du groupe",
    r"\ba épinglé un message",
    # membership and group changes, English
    r"\bwas added\b",
    r"\bwere added\b",
    r"\bjoined using (?:this|the) group",
    r"\bjoined the group\b",
    r"\bcreated (?:the )?group\b",
    r"\bchanged the (?:subject|group name|group description|group(?:'s)? icon)\b",
    r"\bchanged this group",
    r"\bpinned a message\b",
    r"\bwas removed from the group\b",
    r"\bremoved .{1,50} from the group\b",
    # missed calls
    r"missed (?:voice|video) call",
    r"appel (?:vocal|vidéo) manqué",
    # security code
    r"your security code with .{1,60} changed",
    r"votre code de sécurité avec .{1,60} a changé",
]

# Forms described for newer exports; only used with ``extended=True``.
EXTENDED_MEDIA_NOTICES = [r"<attached:", r"^poll:", r"^option:", r"<this message was edited>"]
EXTENDED_SYSTEM_NOTICES = [r"disappearing messages", r"messages éphémères"]
INVISIBLE_MARKS = r"[\x{200e}\x{200f}\x{202a}-\x{202e}]"

# Every notice above contains one of these, in lower case.
NOTICE_WORDS = [
    "omitted", "omis", "encrypted", "chiffr", "learn more", "appuyez", "deleted", "supprim",
    "ajout", "quitt", "rejoint", "group", "pingl", "added", "joined", "changed", "pinned",
    "missed", "manqu", "votre code",
    "<attached", "poll:", "option:", "edited>", "disappearing", "phémères",
]
# Letters other than the capitals that match s, k and i when case is ignored.
CASE_VARIANTS = ("\u017f\u212a\u0130\u0131", "skii")

# Left-overs deleted from message text before tokenising.
ARTEFACTS = r"<media omitted>|média omis|message deleted|message supprimé"

# Phone numbers in running text.
PHONE = r"\+?[0-9][0-9%s\-().]{7,}[0-9]" % SPACE

# Everything that separates two words (a word = letters, numbers, underscore).
NON_WORD = r"[^\p{L}\p{N}_]+"

# Emoji as code-point ranges of the Unicode emoji property.
EMOJI_BASE = (
    r"\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}\x{21aa}"
    r"\x{231a}\x{231b}\x{2328}\x{23cf}\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}"
    r"\x{25aa}\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}\x{2600}-\x{2604}\x{260e}\x{2611}"
    r"\x{2614}\x{2615}\x{2618}\x{261d}\x{2620}\x{2622}\x{2623}\x{2626}\x{262a}\x{262e}"
    r"\x{262f}\x{2638}-\x{263a}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265f}\x{2660}\x{2663}"
    r"\x{2665}\x{2666}\x{2668}\x{267b}\x{267e}\x{267f}\x{2692}-\x{2697}\x{2699}\x{269b}"
    r"\x{269c}\x{26a0}\x{26a1}\x{26a7}\x{26aa}\x{26ab}\x{26b0}\x{26b1}\x{26bd}\x{26be}"
    r"\x{26c4}\x{26c5}\x{26c8}\x{26ce}\x{26cf}\x{26d1}\x{26d3}\x{26d4}\x{26e9}\x{26ea}"
    r"\x{26f0}-\x{26f5}\x{26f7}-\x{26fa}\x{26fd}\x{2702}\x{2705}\x{2708}-\x{270d}\x{270f}"
    r"\x{2712}\x{2714}\x{2716}\x{271d}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}"
    r"\x{274c}\x{274e}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}\x{27a1}"
    r"\x{27b0}\x{27bf}\x{2934}\x{2935}\x{2b05}-\x{2b07}\x{2b1b}\x{2b1c}\x{2b50}\x{2b55}"
    r"\x{3030}\x{303d}\x{3297}\x{3299}\x{1f004}\x{1f0cf}\x{1f170}\x{1f171}\x{1f17e}"
    r"\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}\x{1f1e6}-\x{1f1ff}\x{1f201}\x{1f202}\x{1f21a}"
    r"\x{1f22f}\x{1f232}-\x{1f23a}\x{1f250}\x{1f251}\x{1f300}-\x{1f64f}\x{1f680}-\x{1f6ff}"
    r"\x{1f7e0}-\x{1f7eb}\x{1f7f0}\x{1f90c}-\x{1f9ff}\x{1fa70}-\x{1faff}"
)
EMOJI = (
    r"[0-9#*]\x{fe0f}?\x{20e3}|[%(b)s][%(b)s\x{fe0f}\x{200d}\x{20e3}\x{e0020}-\x{e007f}]*"
    % {"b": EMOJI_BASE}
)

# The span all single-character emoji lie in.
EMOJI_SPAN = r"[\x{a9}\x{ae}\x{203c}-\x{1faff}]"

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Suffixes counted by the media statistics, and the wider set that marks a
# folder as a media folder.
AUDIO_SUFFIXES = [".opus", ".ogg", ".mp3"]
VIDEO_SUFFIXES = [".mp4"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]
MEDIA_SUFFIXES = AUDIO_SUFFIXES + VIDEO_SUFFIXES + IMAGE_SUFFIXES
MEDIA_FOLDER_SUFFIXES = MEDIA_SUFFIXES + [".pdf", ".gif"]

# Sentiment label thresholds (both strict).
POSITIVE_ABOVE = 0.05
NEGATIVE_BELOW = -0.05
# --- end of fixed values ----------------------------------------------------


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"
