"""Dictionaries and thresholds; all can be passed in, these are neutral defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists that results depend on.
STOP_WORDS = (
    "yang dan di ke dari untuk dengan pada adalah ini itu atau juga dalam tidak akan agar oleh sebagai para kami kita anda mereka dia saya bisa dapat harus telah sudah saat jika maka karena "
    "tersebut secara antara setiap namun serta lebih hal bagi yaitu yakni ada menjadi "
    "the a an and or of to in on for with is are be as by at this that it from we you they will can must has have its"
).split()

# Question hooks and their synonyms, first hit wins.
HOOKS = [
    ("definisi", ["pengertian", "what is", "apa itu"]),
    ("definition", ["pengertian", "definisi", "apa itu"]),
    ("prosedur", ["procedure", "langkah", "steps", "cara"]),
    ("procedure", ["prosedur", "langkah", "steps"]),
    ("policy", ["kebijakan", "aturan", "rules"]),
    ("kebijakan", ["policy", "aturan", "rules"]),
    ("compliance", ["kepatuhan", "wajib", "mandatory"]),
    ("kepatuhan", ["compliance", "wajib"]),
]

# Role tags, and those suggested where a chunk of steps has none.
ROLES = ["Field Officer", "FO", "Business Partner", "BP", "A-Team", "Head Office", "HO", "Agent Partner"]
SUGGESTED_ROLES = ["Field Officer", "FO", "BP", "A-Team"]

# Metric patterns and their labels, first hit wins.
METRICS = [
    (r"\d+\s*%", ["completion rate", "tingkat penyelesaian", "satisfaction", "N-Gain"]),
    (r"(?i)N-?Gain", ["learning gain", "Hake's normalized gain"]),
    (r"(?i)\bpre-?test\b", ["post-test", "baseline"]),
]

#: Project aliases; an organisation passes its own.
ALIASES = [("policy", ["rulebook", "POL"]), ("procedure", ["SOP", "playbook"])]


@dataclass(frozen=True)
class NoiseConfig:
    """Slide noise; ``org`` stands in the footers."""

    org: str = "Acme"
    drop_title_only: bool = True
    closing: tuple[str, ...] = ("thank you", "terima kasih", "q&a", "q and a")
    extra: tuple[str, ...] = field(default=())

    @property
    def patterns(self) -> list[str]:
        # What a noise line looks like as a whole.
        return [
            rf"{self.org}\s+Confidential.*",
            rf"©\s*\d{{4}}\s+(?:PT\s+)?{self.org}.*",
            r"\d+\s*/\s*\d+",
            r"Page\s+\d+(?:\s+of\s+\d+)?",
            r"Thank\s*you[!\.]?",
            r"Terima\s+Kasih[!\.]?",
            r"Q\s*&\s*A",
            r"Q\s*and\s*A",
            r"Backup\s+Slides?",
            r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4}",
            *self.extra,
        ]


#: Required frontmatter fields, in the order of their issues.
FIELDS = ["department", "topic", "course_id", "course_name"]
MIN_TOKENS, MAX_TOKENS, RESPLIT_OVER, OVERLAP = 70, 512, 600, 50
