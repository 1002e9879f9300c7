"""Word lists of the default configuration. Every function that uses one also takes a list of the caller's own."""

# Sensational words.
INTENSIFIERS = (
    "terrible", "increíble", "impactante", "alarmante", "horrible", "devastador", "escandaloso", "urgente",
    "brutal", "extremo", "indignante", "horrendo", "gravísimo", "espantoso", "inaudito", "bomba", "shock",
    "pánico", "catástrofe", "tragedia",
)

# Spanish function words.
STOPWORDS = (
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una",
    "su", "al", "lo", "como", "más", "pero", "sus", "le", "ya", "o", "este", "sí", "porque", "esta", "entre",
    "cuando", "muy", "sin", "sobre", "también", "me", "hasta", "hay", "donde", "quien", "desde", "todo", "nos",
    "durante", "todos", "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante", "ellos", "e", "esto", "mí",
    "antes", "algunos", "qué", "unos", "yo", "otro", "otras", "otra", "él", "tanto", "esa", "estos", "mucho",
    "quienes", "nada", "muchos", "cual", "poco", "ella", "estar", "estas", "algunas", "algo", "nosotros", "mi",
    "mis", "tú", "te", "ti", "tu", "tus",
)

# Hedges. The two-word entry can never equal one word; it is kept so that the list reads as given.
HEDGES = ("podría", "podrian", "posible", "posiblemente", "al parecer", "según", "presuntamente", "dicen")

# Words that stand for subordination where no part-of-speech tags are at hand.
SUBORDINATORS = ("que", "porque", "aunque", "si", "cuando", "mientras", "donde")

IMPERSONAL = "se"

# Fixed value: a word of this many letters is long.
LONG_WORD = 8
