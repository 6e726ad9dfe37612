"""Fixed values of the token model.

The type names follow the public Python lexer naming scheme
(``Token.Name``, ``Token.Literal.String.Double`` ...).  The word lists are the
Python language's own keywords, built-in names and special method names.
"""

START_TOKEN = "<|start|>"
UNKNOWN_TOKEN = "<|unknown|>"
END_OF_LINE = "<|endofline|>"
SPACE = "<|space|>"
TAB = "<|tab|>"

START_ID = 0
PAD_ID = 0

TEXT = "Token.Text"
ERROR = "Token.Error"
COMMENT = "Token.Comment.Single"
HASHBANG = "Token.Comment.Hashbang"
DOCSTRING = "Token.Literal.String.Doc"
STRING_SINGLE = "Token.Literal.String.Single"
STRING_DOUBLE = "Token.Literal.String.Double"
STRING_AFFIX = "Token.Literal.String.Affix"
FLOAT = "Token.Literal.Number.Float"
INTEGER = "Token.Literal.Number.Integer"
HEX = "Token.Literal.Number.Hex"
OCT = "Token.Literal.Number.Oct"
BIN = "Token.Literal.Number.Bin"
KEYWORD = "Token.Keyword"
KEYWORD_CONSTANT = "Token.Keyword.Constant"
KEYWORD_NAMESPACE = "Token.Keyword.Namespace"
OPERATOR = "Token.Operator"
OPERATOR_WORD = "Token.Operator.Word"
PUNCTUATION = "Token.Punctuation"
NAME = "Token.Name"
NAME_BUILTIN = "Token.Name.Builtin"
NAME_PSEUDO = "Token.Name.Builtin.Pseudo"
NAME_CLASS = "Token.Name.Class"
NAME_DECORATOR = "Token.Name.Decorator"
NAME_EXCEPTION = "Token.Name.Exception"
NAME_FUNCTION = "Token.Name.Function"
NAME_FUNCTION_MAGIC = "Token.Name.Function.Magic"
NAME_NAMESPACE = "Token.Name.Namespace"
NAME_VARIABLE_MAGIC = "Token.Name.Variable.Magic"

# Token types that never reach the vocabulary.
EXCLUDED_TYPES = (
    "Token.Comment.Hashbang",
    "Token.Comment.Single",
    "Token.Literal.String.Doc",
)

# Open-class types.  A rare token of one of these is replaced by
# the unknown token of its type; ids 1..14 follow this alphabetical order.
OPEN_CLASS_TYPES = (
    "Token.Literal.Number.Float",
    "Token.Literal.Number.Hex",
    "Token.Literal.Number.Integer",
    "Token.Literal.Number.Oct",
    "Token.Literal.String.Double",
    "Token.Literal.String.Escape",
    "Token.Literal.String.Interpol",
    "Token.Literal.String.Single",
    "Token.Name",
    "Token.Name.Class",
    "Token.Name.Decorator",
    "Token.Name.Exception",
    "Token.Name.Function",
    "Token.Name.Namespace",
)

# Python keywords and names with a type of their own.
KEYWORDS = tuple(
    "as assert async await break continue del elif else except finally for "
    "global if lambda nonlocal pass raise return try while with yield".split()
) + ("yield from",)
KEYWORD_CONSTANTS = ("False", "None", "True")
OPERATOR_WORDS = ("and", "in", "is", "not", "or")
# Keywords only in front of white space, names elsewhere.
DEFINING_KEYWORDS = ("class", "def")
IMPORT_KEYWORDS = ("from", "import")

BUILTINS = tuple(
    "__import__ abs aiter all any bin bool breakpoint bytearray bytes callable "
    "chr classmethod compile complex delattr dict dir divmod enumerate eval "
    "filter float format frozenset getattr globals hasattr hash hex id input "
    "int isinstance issubclass iter len list locals map max memoryview min "
    "next object oct open ord pow print property range repr reversed round "
    "set setattr slice sorted staticmethod str sum super tuple type vars "
    "zip".split()
)
PSEUDO_BUILTINS = ("Ellipsis", "NotImplemented", "cls", "self")
EXCEPTIONS = tuple(
    "ArithmeticError AssertionError AttributeError BaseException "
    "BlockingIOError BrokenPipeError BufferError BytesWarning "
    "ChildProcessError ConnectionAbortedError ConnectionError "
    "ConnectionRefusedError ConnectionResetError DeprecationWarning EOFError "
    "EncodingWarning EnvironmentError Exception FileExistsError "
    "FileNotFoundError FloatingPointError FutureWarning GeneratorExit IOError "
    "ImportError ImportWarning IndentationError IndexError InterruptedError "
    "IsADirectoryError KeyError KeyboardInterrupt LookupError MemoryError "
    "ModuleNotFoundError NameError NotADirectoryError NotImplementedError "
    "OSError OverflowError PendingDeprecationWarning PermissionError "
    "ProcessLookupError RecursionError ReferenceError ResourceWarning "
    "RuntimeError RuntimeWarning StopAsyncIteration StopIteration SyntaxError "
    "SyntaxWarning SystemError SystemExit TabError TimeoutError TypeError "
    "UnboundLocalError UnicodeDecodeError UnicodeEncodeError UnicodeError "
    "UnicodeTranslateError UnicodeWarning UserWarning VMSError ValueError "
    "Warning WindowsError ZeroDivisionError".split()
)
MAGIC_FUNCTIONS = tuple(
    "__abs__ __add__ __aenter__ __aexit__ __aiter__ __and__ __anext__ "
    "__await__ __bool__ __bytes__ __call__ __complex__ __contains__ __del__ "
    "__delattr__ __delete__ __delitem__ __dir__ __divmod__ __enter__ __eq__ "
    "__exit__ __float__ __floordiv__ __format__ __ge__ __get__ __getattr__ "
    "__getattribute__ __getitem__ __gt__ __hash__ __iadd__ __iand__ "
    "__ifloordiv__ __ilshift__ __imatmul__ __imod__ __imul__ __index__ "
    "__init__ __instancecheck__ __int__ __invert__ __ior__ __ipow__ "
    "__irshift__ __isub__ __iter__ __itruediv__ __ixor__ __le__ __len__ "
    "__length_hint__ __lshift__ __lt__ __matmul__ __missing__ __mod__ __mul__ "
    "__ne__ __neg__ __new__ __next__ __or__ __pos__ __pow__ __prepare__ "
    "__radd__ __rand__ __rdivmod__ __repr__ __reversed__ __rfloordiv__ "
    "__rlshift__ __rmatmul__ __rmod__ __rmul__ __ror__ __round__ __rpow__ "
    "__rrshift__ __rshift__ __rsub__ __rtruediv__ __rxor__ __set__ "
    "__setattr__ __setitem__ __str__ __sub__ __subclasscheck__ __truediv__ "
    "__xor__".split()
)
MAGIC_VARIABLES = tuple(
    "__annotations__ __bases__ __class__ __closure__ __code__ __defaults__ "
    "__dict__ __doc__ __file__ __func__ __globals__ __kwdefaults__ __module__ "
    "__mro__ __name__ __objclass__ __qualname__ __self__ __slots__ "
    "__weakref__".split()
)

# One-character operators and punctuation.
OPERATOR_CHARS = tuple("-~+/*%=<>&^|.@")
OPERATOR_PAIRS = ("!=", "==", "<<", ">>", ":=")
PUNCTUATION_CHARS = tuple("]{}:(),;[")

# String prefixes, and those a docstring may carry (compared in
# lower case).
STRING_PREFIXES = (
    "b", "br", "f", "fr", "r", "rb", "rf", "rt", "t", "tr", "u",
)
DOCSTRING_PREFIXES = ("b", "bb", "br", "bu", "r", "rb", "rr", "ru", "u", "ub", "ur", "uu")

# Run configuration defaults.
DEFAULT_HPARAMS = (
    ("n_vocab", 0),
    ("n_embd", 768),
    ("n_ctx", 1024),
    ("n_head", 12),
    ("n_layer", 12),
)

FREQUENCY_THRESHOLD = 20
MIN_TOKENS = 10
N_CTX = 1024
BATCH_SIZE = 8
TOP_K = 10
