"""Word lists, lookup tables, patterns and limits that results depend on."""

import re

STOP_WORDS = "a an and are at avoid be but exclude for from i if in into is it ive i've like me movie movies no not of on or something that that's thats the to want watch with without".split()
QUALITY_FILLERS = "all best ever favorite good great greatest high highly masterpiece must popular acclaimed rated rating time top watch".split()
REQUEST_FILLERS = "cast casting directed dislikes fan fans film films find give likes recommend recommendation please show someone starring suggest who".split()
MOOD_TERMS = ["speed", "exciting", "action", "race", "chase", "suspenseful"]

GENRES = {
    "action": "action", "adventure": "adventure", "anime": "animation", "animation": "animation", "animated": "animation",
    "comedy": "comedy", "crime": "crime", "doc": "documentary", "documentary": "documentary", "documentaries": "documentary",
    "drama": "drama", "family": "family", "fantasy": "fantasy", "history": "history", "historical": "history",
    "horror": "horror", "scary": "horror", "spooky": "horror", "creepy": "horror", "frightening": "horror",
    "music": "music", "musical": "music", "mystery": "mystery", "romance": "romance", "romantic": "romance",
    "sci fi": "science fiction", "sci-fi": "science fiction", "scifi": "science fiction", "science fiction": "science fiction",
    "thriller": "thriller", "war": "war", "western": "western",
}
CERTIFICATES = {
    "family friendly": ["g", "pg"], "family-friendly": ["g", "pg"], "kid friendly": ["g", "pg"], "kid-friendly": ["g", "pg"],
    "kids": ["g", "pg"], "children": ["g"], "pg": ["pg"], "pg-13": ["pg-13"], "pg13": ["pg-13"],
    "r-rated": ["r"], "r rated": ["r"], "adult": ["r", "nc-17"], "mature": ["r", "nc-17"],
}
#: term: (language codes, countries), in the order in which the first mentioned one counts
LANGUAGES = {
    "korean": (["ko"], ["south korea"]), "k-drama": (["ko"], ["south korea"]), "kdrama": (["ko"], ["south korea"]),
    "japanese": (["ja"], ["japan"]), "j-horror": (["ja"], ["japan"]), "jdrama": (["ja"], ["japan"]), "anime": (["ja"], ["japan"]),
    "chinese": (["zh", "cn"], ["china", "hong kong", "taiwan"]), "mandarin": (["zh", "cn"], ["china"]), "cantonese": (["zh"], ["hong kong"]),
    "taiwanese": (["zh"], ["taiwan"]), "chinese cinema": (["zh", "cn"], ["china", "hong kong", "taiwan"]),
    "thai": (["th"], ["thailand"]), "vietnamese": (["vi"], ["vietnam"]), "philippine": (["fil"], ["philippines"]), "filipin": (["fil"], ["philippines"]),
    "malaysian": (["ms"], ["malaysia"]), "singapore": (["zh", "en"], ["singapore"]), "thai cinema": (["th"], ["thailand"]),
    "indian": (["hi", "te", "ta", "ml", "bn", "ur"], ["india"]), "bollywood": (["hi"], ["india"]), "tamil": (["ta"], ["india"]), "telugu": (["te"], ["india"]),
    "malayalam": (["ml"], ["india"]), "bengali": (["bn"], ["india"]), "urdu": (["ur"], ["india", "pakistan"]), "pakistani": (["ur"], ["pakistan"]),
    "french": (["fr"], ["france", "belgium"]), "german": (["de"], ["germany", "austria"]), "austrian": (["de"], ["austria"]), "british": (["en"], ["united kingdom"]),
    "italian": (["it"], ["italy"]), "spanish": (["es"], ["spain", "mexico", "argentina", "colombia"]), "spanish cinema": (["es"], ["spain"]),
    "latin american": (["es"], ["mexico", "argentina", "colombia", "chile", "peru"]), "mexican": (["es"], ["mexico"]), "argentinian": (["es"], ["argentina"]),
    "colombian": (["es"], ["colombia"]), "portuguese": (["pt"], ["portugal", "brazil"]), "brazilian": (["pt"], ["brazil"]), "polish": (["pl"], ["poland"]),
    "czech": (["cs"], ["czech republic"]), "hungarian": (["hu"], ["hungary"]), "romanian": (["ro"], ["romania"]), "greek": (["el"], ["greece"]),
    "scandinavian": (["no", "da", "fi", "sv", "is"], ["sweden", "norway", "denmark", "finland", "iceland"]), "swedish": (["sv"], ["sweden"]),
    "norwegian": (["no"], ["norway"]), "danish": (["da"], ["denmark"]), "finnish": (["fi"], ["finland"]), "icelandic": (["is"], ["iceland"]),
    "dutch": (["nl"], ["netherlands", "belgium"]), "belgian": (["nl", "fr"], ["belgium"]), "russian": (["ru"], ["russia", "soviet union"]), "soviet": (["ru"], ["soviet union"]),
    "ukrainian": (["uk"], ["ukraine"]), "arabic": (["ar"], ["egypt", "lebanon", "uae", "saudi arabia", "jordan", "iraq"]),
    "middle eastern": (["ar"], ["egypt", "lebanon", "uae", "saudi arabia", "jordan"]), "hebrew": (["he"], ["israel"]), "israeli": (["he"], ["israel"]),
    "turkish": (["tr"], ["turkey"]), "farsi": (["fa"], ["iran"]), "persian": (["fa"], ["iran"]), "iranian": (["fa"], ["iran"]),
    "nigerian": ([], ["nigeria"]), "nollywood": ([], ["nigeria"]), "south african": ([], ["south africa"]),
    "african cinema": ([], ["nigeria", "south africa", "senegal", "kenya"]), "caribbean": (["es", "en"], ["cuba", "puerto rico"]),
    "foreign": (["ko", "ja", "fr", "zh", "cn", "es", "de", "it", "hi", "ru", "th", "vi"], []),
    "international": (["ko", "ja", "fr", "zh", "cn", "es", "de", "it", "hi", "ru", "th", "vi"], []),
    "subtitled": (["ko", "ja", "fr", "zh", "cn", "es", "de", "it", "hi", "ru", "th", "vi"], []), "dubbed": ([], []), "original language": ([], []),
}

_BIOGRAPHY = ["biography", "biographical", "based on true story", "true story", "real life"]
_SPORT = ["athlete", "championship", "coach", "team", "tournament", "boxing", "football", "basketball", "baseball", "soccer", "olympics"]
_YOUTH = ["coming of age", "adolescence", "teenager", "growing up", "youth", "high school"]
_INDIE = ["independent film", "indie", "arthouse", "art house", "low budget", "sundance"]
SUBGENRES = {
    "courtroom": ["trial", "courthouse", "lawyer", "verdict", "jury", "legal", "court case", "attorney", "judge", "prosecution"],
    "biopic": _BIOGRAPHY, "biographical": _BIOGRAPHY,
    "superhero": ["superhero", "based on comic", "comic book", "superpower", "vigilante", "masked hero"],
    "heist": ["robbery", "theft", "steal", "con artist", "bank robbery", "casino", "thief", "caper"],
    "sports": _SPORT, "sport": _SPORT,
    "slasher": ["serial killer", "masked killer", "slasher", "murder", "killer"],
    "zombie": ["zombie", "undead", "infection", "apocalypse", "outbreak"],
    "vampire": ["vampire", "blood", "undead", "immortal"],
    "psychological": ["psychological", "mind", "mental", "paranoia", "psyche", "delusion"],
    "noir": ["noir", "detective", "femme fatale", "hard-boiled", "cynical"],
    "coming of age": _YOUTH, "coming-of-age": _YOUTH,
    "indie": _INDIE, "independent": _INDIE,
    "martial arts": ["martial arts", "kung fu", "karate", "fighting", "combat"],
    "time travel": ["time travel", "time machine", "temporal", "time loop"],
    "disaster": ["disaster", "catastrophe", "survival", "natural disaster", "apocalypse"],
    "spy": ["spy", "espionage", "secret agent", "undercover", "intelligence"],
}


def bordered(pattern: str) -> str:
    r"""A pattern whose ``\b`` are borders of ASCII words, as in SQL; Java's count letters beyond ASCII as parts of a word.

    One before a letter, digit, group or class opens a word, any other closes one.
    """
    return re.sub(r"\\b(?![a-z0-9(\[\\])", r"(?!\\w)", pattern).replace(r"\b", r"(?<!\w)")


QUALITY = bordered(r"\b(?:good|great|best|top|high[-\s]?quality|high[-\s]?rated|highly rated|acclaimed|popular|crowd[-\s]?pleasing|well reviewed|must[-\s]?watch|greatest|masterpiece)\b")
ALL_TIME = bordered(r"\b(?:best|greatest|top)(?:\s+[a-z0-9]+){0,5}\s+(?:of\s+)?all\s+time\b|\ball[-\s]?time\s+(?:best|great|classic|favorite)\b")
MOOD = bordered(r"\bfast[-\s]?paced\b|\bfast\s+movie\b|\bexciting\b|\bhigh[-\s]?energy\b")
FUZZY = bordered(r"\b(?:like|similar|vibe|feel|feels|style|mood|tone|atmospheric|thoughtful|weird|grounded|bleak|slow[-\s]?burn|dystopian|modern story|modern setting|epic|intense|tense|mind[-\s]?bending|light[-\s]?hearted|uplifting|heartwarming|charming|comfort|cozy)\b")
SIMILAR = bordered(r"\b(?:like|similar to|something like|in the vein of|along the lines of)\b")
RELEASE = bordered(r"\b(?:released|release|made|produced|came out|from|movie from|film from|after|before|since|newer than|older than|between|recent|newer|latest|classic)\b")
SET_IN = bordered(r"\bset (?:in|during)\b")
SHORT = bordered(r"\b(?:short|quick|brief|light(?:\s+watch)?)\b")
LONG = bordered(r"\b(?:long|epic|lengthy)\b")
MAX_RUNTIME = bordered(r"\b(?:under|less than|within|below|max(?:imum)?|up to)\s+(\d+(?:\.\d+)?)\s*(hours?|hrs?|h|minutes?|mins?|m)?\b")
MIN_RUNTIME = bordered(r"\b(?:over|more than|at least|min(?:imum)?)\s+(\d+(?:\.\d+)?)\s*(hours?|hrs?|h|minutes?|mins?|m)?\b")
MODERN = bordered(r"\b(?:based in modern times|set in modern times|takes place in modern times|modern setting|modern day|modern-day|present day|present-day)\b")
PAST = bordered(r"\b(?:period piece|period drama|historical setting|set in the past)\b")
ERA = bordered(r"\bset (?:in|during) (?:the )?((?:19|20)\d0s|80s|90s|(?:19|20)\d{2})\b")
MIN_RATING = bordered(
    r"\b(?:imdb\s+)?(?:rating|rated|score)\s*(?:above|over|at least|higher than|>=)\s*(\d(?:\.\d+)?)\b"
    r"|(?:\b(?:above|over|at least|higher than)|(?<=\w)>=)\s*(\d(?:\.\d+)?)\s*(?:/10)?\s*(?:imdb\s+)?(?:rating|rated|score)\b"
)
LIKES = bordered(r"\b(?:likes?|loves?)\s+([a-z0-9][a-z0-9\-\s]{0,32}?)(?=\s+(?:films?|movies?)\b|,|\.|;|$)")
FANS = bordered(r"\b([a-z0-9][a-z0-9\-\s]{0,24}?)\s+fans?\b")
NEGATION = bordered(r"\b(?:no|not|without|avoid)\s+([a-z0-9][a-z0-9\-\s]{0,32}?)(?=,|\.|;|\bbut\b|\bexcept\b|\binstead\b|$)")
NON = bordered(r"\bnon[-\s]+([a-z0-9]+)\b")
DISLIKES = bordered(r"\b(?:dislikes?|hates?|doesn'?t like|do not like)\s+([a-z0-9][a-z0-9\-\s]{0,24}?)(?=,|\.|;|\bbut\b|\bwith\b|\bfilms?\b|\bmovies?\b|$)")
YEAR_PHRASES = ["recent", "newer", "latest", "older", "classic", "relatively new", "new movie", "older movie", "old movie", "this decade", "last decade"]

#: The closed vocabularies of tags, and how many of each an item may have.
TONE_TAGS = "grounded serious dark gritty tense intense warm intimate thoughtful cerebral haunting bleak moody lighthearted uplifting romantic funny campy".split()
AUDIENCE_TAGS = "date_night group_watch solo_watch late_night_watch family_watch easy_watch requires_attention rewatchable conversation_starter comfort_watch".split()
SOURCE_TAGS = "novel_adaptation comic_adaptation video_game_adaptation true_story myth_folklore original".split()
TAGS = {"tone_tags_json": (TONE_TAGS, 4), "audience_tags_json": (AUDIENCE_TAGS, 4), "source_tags_json": (SOURCE_TAGS, 3)}
AUGMENTED = ["essence", "tone_tags_json", "source_tags_json", "keywords_augmented_json", "audience_tags_json"]
#: Columns whose words make an item's search text.
TEXT_COLUMNS = (
    "title original_title genres overview tagline keywords director top_cast original_language production_countries production_companies collection_name "
    "spoken_languages alternative_titles us_rating essence tone_tags_json audience_tags_json source_tags_json keywords_augmented_json"
).split()
#: How many rows of the shortlist each route hands on.
ROUTES = {"description_only": 1, "judge_5": 5, "judge_8": 8}
#: Seconds: in all, kept for the fallback, kept as a margin, and the least a final call needs.
BUDGET, BUFFER, MARGIN, LEAST_LEFT = 20.0, 1.0, 1.0, 2.0

#: Year that "recent" and the decades count from.
THIS_YEAR = 2024
BM25_K1, BM25_B = 1.45, 0.72
LEXICAL_TOP, DENSE_TOP, POOL, SECOND_STAGE, SHORTLIST, RRF, OVERVIEW_TERMS = 80, 30, 60, 36, 10, 60, 18
FIELD_WEIGHTS = {
    "title": 4.0, "genres": 3.4, "original_title": 3.0, "alternative_titles": 3.0, "keywords": 3.0, "tone_tags_json": 2.5,
    "director": 2.2, "audience_tags_json": 2.0, "top_cast": 2.0, "source_tags_json": 1.8, "tagline": 1.8,
    "production_countries": 1.4, "spoken_languages": 1.4, "original_language": 1.2, "essence": 1.1, "overview": 1.0,
}
