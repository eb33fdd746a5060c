"""Word lists and patterns that results hang on."""

from pathlib import Path

#: The stop words that token sequences lose.
STOP_WORDS = """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him
    his himself she she's her hers herself it it's its itself they them their theirs themselves what which who
    whom this that that'll these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very s
    t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn
    didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't
    needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

#: Identifiers that keep their name.
PYTHON_KEYWORDS = """
    False None True and as assert async await break class continue def del elif else except finally for from
    global if import in is lambda nonlocal not or pass raise return try while with yield print range self len
    str int float list dict set tuple super __init__
""".split()

#: Identifiers that keep their name.
JAVA_KEYWORDS = """
    abstract assert boolean break byte case catch char class const continue default do double else enum
    extends final finally float for goto if implements import instanceof int interface long native new package
    private protected public return short static strictfp super switch synchronized this throw throws
    transient try void volatile while true false null var String System out println main Override
""".split()

#: Identifiers that keep their name.
CPP_KEYWORDS = """
    alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t
    class compl concept const const_cast consteval constexpr constinit continue co_await co_return co_yield
    decltype default delete do double dynamic_cast else enum explicit export extern false float for friend
    goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private
    protected public register reinterpret_cast requires return short signed sizeof static static_assert
    static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned
    using virtual void volatile wchar_t while xor xor_eq include define ifdef endif std cout cin endl vector
    string
""".split()

#: Substrings that tell a language.
PYTHON_SIGNALS = [
    "def ", "import ", "self", "elif ", "pass", "print(", "range(", "__init__", "str(", "len(", "yield ",
]

#: Substrings that tell a language.
CPP_SIGNALS = [
    "#include", "std::", "using namespace", "->", "::", "cout", "cin", "nullptr", "template", "auto ",
    "vector<", "struct ", "virtual", "int main", "void main",
]

#: Substrings that tell a language.
JAVA_SIGNALS = [
    "public class", "public int", "static void main", "System.out", "Math.", ".charAt", "implements",
    "extends", "package ", "throws ", "String ", "boolean ", "ArrayList", "HashMap", "List<", "@Override",
    "Integer", "interface ",
]

#: Tokens of source code.
LEXERS = {
    "python": r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|==|!=|<=|>=|[+\-*/=(){}.;,<>\[\]%!&|^]",
    "java": r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|==|!=|<=|>=|&&|\|\||[+\-*/=(){}.;,<>\[\]%!&|^@]",
    "cpp": r"::|->|[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|==|!=|<=|>=|&&|\|\||[+\-*/=(){}.;,<>\[\]%!&|^#]",
}
KEYWORDS = {"python": PYTHON_KEYWORDS, "java": JAVA_KEYWORDS, "cpp": CPP_KEYWORDS}
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"

#: A few nouns by rule of the lemmatiser (its full dictionary is a parameter): endings in -s go, also where they shouldn't.
LEMMAS = {"was": "wa", "has": "ha", "does": "doe", "us": "u", "compares": "compare", "documents": "document"}


def tfidf_stop_words(path: str | None = None) -> list[str]:
    """The stop words of TF-IDF terms: a text file of words, with # for comments."""
    lines = Path(path or Path(__file__).with_name("stop_words_tfidf.txt")).read_text().splitlines()
    return [w for line in lines if not line.startswith("#") for w in line.split()]
