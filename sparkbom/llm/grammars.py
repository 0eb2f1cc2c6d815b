"""Grammars of the five languages, in the notation of :mod:`sparkbom.llm.tables`.

They recognise and build no tree, so binary operators share one level wherever precedence cannot decide whether a text
parses. Contextual words are names in rules that say so.
"""

JSON = """
text = value
value = object | array | STRING | NUMBER | 'true' | 'false' | 'null'
object = '{' (member (',' member)*)? '}'
member = STRING ':' value
array = '[' (value (',' value)*)? ']'
"""

TOML = """
doc = line (NL line)*
line = entry? | '[' key ']' | '[[' key ']]'
entry = key '=' value
key = part ('.' part)*
part = BARE | STRING
value = STRING | MLSTRING | SCALAR | array | table
array = '[' NL* (value NL* (',' NL* value NL*)* (',' NL*)?)? ']'
table = '{' (entry (',' entry)*)? '}'
"""

PYTHON = """
file = stmt*
stmt = line | compound
line = simple (';' simple)* ';'? NEWLINE
simple = assign | exprs | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'pass' | 'break' | 'continue' | 'del' dropped (',' dropped)* ','?
  | yield | 'assert' expr (',' expr)? | ('global' | 'nonlocal') name (',' name)* | import | 'type' name tparams? '=' expr
assign = chain value | single ':' expr ('=' value)? | single AUG value
chain = targets '=' | chain targets '='
value = exprs | yield
yield = 'yield' exprs? | 'yield' 'from' expr
single = name | primary '.' name | primary '[' slices ']' | '(' single ')'
plain = name | primary '.' name | primary '[' slices ']' | '(' targets? ')' | '[' targets? ']'
target = plain | '*' plain
dropped = name | primary '.' name | primary '[' slices ']' | '(' (dropped (',' dropped)* ','?)? ')' | '[' (dropped (',' dropped)* ','?)? ']'
targets = target (',' target)* ','?
import = 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' origin 'import' names
origin = dotted | dots dotted?
dots = '.' | '...' | dots '.' | dots '...'
names = '*' | aliases | '(' aliases ','? ')'
aliases = name ('as' name)? (',' name ('as' name)?)*
dotted = name ('.' name)*
name = capture | '_'
capture = NAME | 'match' | 'case' | 'type'
exprs = item (',' item)* ','?
item = expr | '*' arith
named = expr | name ':=' expr
expr = bool | bool 'if' bool 'else' expr | 'lambda' lparams? ':' expr
bool = not | bool 'and' not | bool 'or' not
not = 'not' not | cmp
cmp = arith | cmp cmpop arith
cmpop = CMP | '<' | '>' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
arith = unary | arith binop unary
binop = BIN | '*' | '+' | '-' | '|' | '@' | '/'
unary = ('+' | '-' | '~') unary | power
power = awaited | awaited '**' unary
awaited = primary | 'await' primary
primary = atom | primary '.' name | primary '(' args? ')' | primary '(' named for ')' | primary '[' slices ']'
atom = name | NUMBER | IMAGINARY | strings | 'None' | 'True' | 'False' | '...' | '(' tuple? ')' | '(' yield ')' | '(' named for ')' | '[' tuple? ']' | '[' named for ']'
  | '{' '}' | '{' pairs '}' | '{' expr ':' expr for '}' | '{' tuple '}' | '{' named for '}'
tuple = titem (',' titem)* ','?
titem = named | '*' arith
pairs = pair (',' pair)* ','?
pair = expr ':' expr | '**' arith
for = clause | for clause
clause = 'async'? 'for' targets 'in' bool | clause 'if' bool
args = pos ','? | pos ',' keys ','? | keys ','?
pos = posarg | pos ',' posarg
posarg = named | '*' expr
keys = keys1 | keys1 ',' keys2 | keys2
keys1 = key | keys1 ',' (key | '*' expr)
keys2 = '**' expr | keys2 ',' (key | '**' expr)
key = name '=' expr
slices = slice (',' slice)* ','?
slice = named | '*' arith | expr? ':' expr? | expr? ':' expr? ':' expr?
strings = texts | octets
texts = string | texts string
octets = BYTES | octets BYTES
string = STRING | FSTRING_START fpart* FSTRING_END
fpart = FSTRING_MIDDLE | '{' value '='? fconv? fspec? '}'
fconv = '!' name
fspec = ':' fpart*
lparams = lhead ','? | lhead ',' ltail ','? | ltail ','?
lhead = lfree | lgiven | lslash | lslashgiven
lfree = name | lfree ',' name
lgiven = lset | lfree ',' lset | lgiven ',' lset
lslash = lfree ',' '/' | lslash ',' name
lslashgiven = lgiven ',' '/' | lslash ',' lset | lslashgiven ',' lset
lset = name '=' expr
ltail = '*' name lrest | '*' (',' lkey)+ lwide? | lwild
lrest = (',' lkey)* lwide?
lkey = name | lset
lwide = ',' lwild
lwild = '**' name
params = head ','? | head ',' tail ','? | tail ','?
head = free | given | slash | slashgiven
free = param | free ',' param
given = set | free ',' set | given ',' set
slash = free ',' '/' | slash ',' param
slashgiven = given ',' '/' | slash ',' set | slashgiven ',' set
param = name (':' expr)?
set = param '=' expr
tail = '*' name (':' item)? rest | '*' (',' keyed)+ wide? | wild
rest = (',' keyed)* wide?
keyed = param | set
wide = ',' wild
wild = '**' param
tparams = '[' tparam (',' tparam)* ','? ']'
tparam = name (':' expr)? ('=' expr)? | '*' name ('=' item)? | '**' name ('=' expr)?
block = NEWLINE INDENT stmt+ DEDENT | line
compound = if | while | 'async'? forstmt | try | 'async'? with | decorator* 'async'? def | decorator* class | match
decorator = '@' named NEWLINE
if = 'if' named ':' block | 'if' named ':' block else | 'if' named ':' block elif
elif = 'elif' named ':' block | 'elif' named ':' block else | 'elif' named ':' block elif
else = 'else' ':' block
while = 'while' named ':' block else?
forstmt = 'for' targets 'in' exprs ':' block else?
try = 'try' ':' block 'finally' ':' block | 'try' ':' block (except+ | group+) else? | 'try' ':' block (except+ | group+) else? 'finally' ':' block
except = 'except' ':' block | 'except' expr ('as' name)? ':' block
group = 'except' '*' expr ('as' name)? ':' block
with = 'with' withitem (',' withitem)* ':' block | 'with' '(' withitem (',' withitem)* ','? ')' ':' block
withitem = expr | expr 'as' target
def = 'def' name tparams? '(' params? ')' ('->' expr)? ':' block
class = 'class' name tparams? ':' block | 'class' name tparams? '(' args? ')' ':' block
match = 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject = named | item ',' | item (',' item)+ ','?
case = 'case' patterns ('if' named)? ':' block
patterns = pattern | open
open = starred ',' | starred (',' starred)+ ','?
starred = pattern | '*' name
pattern = orpat | orpat 'as' capture
orpat = closed | orpat '|' closed
closed = number | strings | 'None' | 'True' | 'False' | dotted | '(' pattern ')' | '(' open? ')' | '[' ']' | '[' starred ']' | '[' open ']' | '{' mapping? '}' | dotted '(' pargs? ')'
number = real | imaginary | real ('+' | '-') IMAGINARY
real = NUMBER | '-' NUMBER
imaginary = IMAGINARY | '-' IMAGINARY
mapping = mitems ','? | mitems ',' '**' capture ','? | '**' capture ','?
mitems = mitem | mitems ',' mitem
mitem = mkey ':' pattern
mkey = number | strings | 'None' | 'True' | 'False' | name '.' dotted
pargs = ppos ','? | ppos ',' pkey ','? | pkey ','?
ppos = pattern | ppos ',' pattern
pkey = name '=' pattern | pkey ',' name '=' pattern
"""

_JS_WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum null true false"
).split()
_JS_IDENTS = "NAME async of get set let static".split()
_quoted = lambda words: " | ".join(w if w.isupper() else f"'{w}'" for w in words)

# Rules with <S> exist three times: plain, _s (may start a statement: no brace, function or class) and _b (no brace). <O> is the
# object pattern where a brace may stand.
_JS_EXPR = """
expr<S> = assign<S> | expr<S> ',' assign
assign<S> = cond<S> | ref<S> ('=' | ASSIGN) assign | array '=' assign<O> | arrow | 'yield' | 'yield' assign | 'yield' '*' assign
cond<S> = bin<S> | bin<S> '?' assign ':' assign
bin<S> = unary<S> | bin<S> binop unary | PRIVATE 'in' unary
unary<S> = postfix<S> | unop unary | ('++' | '--' | NLINC) ref
postfix<S> = lhs<S> | ref<S> '++' | ref<S> '--'
lhs<S> = mem<S> | chain<S>
chain<S> = lhs<S> '?.' field | lhs<S> '?.' args | lhs<S> '?.' '[' expr ']' | chain<S> '.' field | chain<S> '[' expr ']' | chain<S> args | chain<S> template
mem<S> = ref<S> | val<S>
ref<S> = ident | mem<S> '.' field | mem<S> '[' expr ']' | 'super' '.' field | 'super' '[' expr ']' | '(' ref ')'
val<S> = <A> | mem<S> args | mem<S> template | 'new' newer args | 'new' newer | 'new' '.' NAME | 'super' args | 'import' '(' assign (',' assign)? ','? ')'
"""
_JS_ATOM = "NUMBER | STRING | REGEX | 'this' | 'null' | 'true' | 'false' | template | '(' expr ')' | array"
_JS_STARTS = {"": (_JS_ATOM + " | object | function | class", " | object '=' assign"), "_s": (_JS_ATOM, ""), "_b": (_JS_ATOM + " | function | class", "")}
# The brace that opens a function's body is FB, with A where it may await and G where it may yield, and the arrow of an async
# function is =>A: only the rules know which function a brace belongs to, and words mean other things within. COVER is an equals
# sign that makes sense only if the object turns out to be a pattern.
JAVASCRIPT = f"""
script = stmt*
stmt = sub | lexical | fdecl | 'class' ident classtail
sub = block | ';' | 'var' binding (',' binding)* semi | expr_s semi | if | loop | 'continue' ident? semi | 'break' ident? semi | 'return' expr? semi | 'throw' expr semi | try | switch
  | ident ':' within | 'debugger' semi | 'with' '(' expr ')' sub
within = sub | fdecl
semi = ';' | ASI
block = '{{' stmt* '}}'
fblock = FB stmt* '}}'
ablock = FBA stmt* '}}'
gblock = FBG stmt* '}}'
agblock = FBAG stmt* '}}'
lexical = 'let' lbinding (',' lbinding)* semi | 'const' cbinding (',' cbinding)* semi
binding = ident | ident '=' assign | pattern '=' assign
lbinding = lident | cbinding
cbinding = lident '=' assign | pattern '=' assign
target = ident | pattern
pattern = '[' ','* ']' | '[' pelems ','* ']' | '{{' '}}' | '{{' pprop (',' pprop)* ','? '}}' | '{{' (pprop ',')* '...' ident '}}'
pelems = ','* pelem | pelems ','+ pelem
pelem = target | target '=' assign | '...' target
pprop = pname ':' target | pname ':' target '=' assign | ident | ident '=' assign
if = 'if' '(' expr ')' within | 'if' '(' expr ')' within 'else' within
loop = 'while' '(' expr ')' sub | 'do' sub 'while' '(' expr ')' semi | 'do' sub 'while' '(' expr ')'
  | 'for' '(' forinit? ';' expr? ';' expr? ')' sub | 'for' '(' each 'in' expr ')' sub | 'for' 'await'? '(' each 'of' assign ')' sub
forinit = expr | 'var' binding (',' binding)* | 'let' lbinding (',' lbinding)* | 'const' cbinding (',' cbinding)*
each = ref | array | object | 'var' target | ('let' | 'const') (lident | pattern)
try = 'try' block catch | 'try' block catch? 'finally' block
catch = 'catch' block | 'catch' '(' target ')' block
switch = 'switch' '(' expr ')' '{{' arm* '}}'
arm = 'case' expr ':' stmt* | 'default' ':' stmt*
params = plist ','? | plist ',' '...' target | '...' target
plist = param | plist ',' param
param = target ('=' assign)?
fdecl = 'function' ident '(' params? ')' fblock | 'function' '*' ident '(' params? ')' gblock | 'async' 'function' ident '(' params? ')' ablock | 'async' 'function' '*' ident '(' params? ')' agblock
function = 'function' ident? '(' params? ')' fblock | 'function' '*' ident? '(' params? ')' gblock | 'async' 'function' ident? '(' params? ')' ablock | 'async' 'function' '*' ident? '(' params? ')' agblock
class = 'class' ident? classtail
classtail = ('extends' lhs)? '{{' member* '}}'
member = ';' | 'static'? method | 'static'? pname ('=' assign)? semi | 'static' block
method = pname '(' params? ')' fblock | ('get' | 'set') pname '(' params? ')' fblock | '*' pname '(' params? ')' gblock | 'async' pname '(' params? ')' ablock | 'async' '*' pname '(' params? ')' agblock
pname = ident | PRIVATE | STRING | NUMBER | '[' assign ']' | word
object = '{{' '}}' | '{{' prop (',' prop)* ','? '}}'
prop = pname ':' assign | ident | ident COVER assign | '...' assign | method
array = '[' ','* ']' | '[' elems ','* ']'
elems = ','* elem | elems ','+ elem
elem = assign | '...' assign
args = '(' ')' | '(' elem (',' elem)* ','? ')'
template = TEMPLATE | THEAD expr (TMID expr)* TTAIL
arrow = ident '=>' body | '(' params? ')' '=>' body | 'async' ident '=>A' abody | 'async' '(' params? ')' '=>A' abody
body = fblock | assign_b
abody = ablock | assign_b
newer = ident | {_JS_ATOM} | object | function | class | newer '.' field | newer '[' expr ']' | newer template | 'super' '.' field | 'new' newer args | 'new' '.' NAME
field = ident | word | PRIVATE
ident = lident | 'let'
lident = {_quoted([x for x in _JS_IDENTS if x != "let"])}
word = {_quoted([*_JS_WORDS, "await", "yield"])}
binop = BIN | 'in' | 'instanceof' | '+' | '-' | '*' | '/' | '<' | '>'
unop = '+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await'
""" + "".join(_JS_EXPR.replace("array '=' assign<O>", "array '=' assign" + o).replace("<S>", k).replace("<A>", a) for k, (a, o) in _JS_STARTS.items())

JAVA_IDENTS = "NAME record var yield sealed permits module open with to requires transitive exports opens uses provides".split()
JAVA = f"""
unit = package? import* typedecl* | import* annotation* 'open'? 'module' qname '{{' directive* '}}'
directive = 'requires' ('transitive' | 'static')* qname ';' | ('exports' | 'opens') qname ('to' qnames)? ';' | 'uses' qname ';' | 'provides' qname 'with' qnames ';'
qnames = qname (',' qname)*
package = annotation* 'package' qname ';'
import = 'import' 'static'? qname ';' | 'import' 'static'? qname '.' '*' ';' | ';'
qname = ident | qname '.' ident
ident = {_quoted(JAVA_IDENTS)}
typedecl = modifier* bare
bare = 'class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
  | 'interface' ident tparams? ('extends' types)? ('permits' types)? classbody
  | 'enum' ident ('implements' types)? '{{' constants? (';' member*)? '}}'
  | 'record' ident tparams? '(' params? ')' ('implements' types)? classbody
  | '@' 'interface' ident classbody
modifier = MODIFIER | 'static' | 'final' | 'default' | 'synchronized' | 'sealed' | 'non-sealed' | annotation
annotation = '@' qname | '@' qname '(' ')' | '@' qname '(' avalue ')' | '@' qname '(' apair (',' apair)* ')'
apair = ident '=' avalue
avalue = cond | annotation | '{{' (avalue (',' avalue)*)? ','? '}}'
constants = constant (',' constant)* ','? | ','
constant = annotation* ident args? classbody?
types = type (',' type)*
tparams = '<' tparam (',' tparam)* '>'
tparam = annotation* ident ('extends' type ('&' type)*)?
type = PRIMITIVE dims? | ctype dims?
ctype = ident | ident targs | ctype '.' ident | ctype '.' ident targs
targs = '<' '>' | '<' targ (',' targ)* '>'
targ = annotation* type | annotation* '?' | annotation* '?' ('extends' | 'super') annotation* type
dims = '[' ']' | dims '[' ']'
classbody = '{{' member* '}}'
member = ';' | typedecl | block | 'static' block | modifier* field | modifier* tparams? method
field = type vars ';'
vars = vardecl (',' vardecl)*
vardecl = ident dims? | ident dims? '=' init
init = expr | '{{' (init (',' init)*)? ','? '}}'
method = (type | 'void') ident '(' params? ')' dims? throws? (block | ';') | type ident '(' ')' dims? 'default' avalue ';' | ident '(' params? ')' throws? block | ident block
throws = 'throws' types
params = param (',' param)*
param = (annotation | 'final')* type '...'? ident dims? | type ident '.' 'this' | type 'this'
block = '{{' blockstmt* '}}'
blockstmt = stmt | localvar ';' | typedecl
localvar = (annotation | 'final')* type vars
stmt = block | ';' | exprstmt ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' forinit? ';' expr? ';' exprstmts? ')' stmt | 'for' '(' (annotation | 'final')* type ident dims? ':' expr ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' ident? ';'
  | 'continue' ident? ';' | 'yield' expr ';' | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | ident ':' stmt | switch | try
forinit = localvar | exprstmts
exprstmts = exprstmt (',' exprstmt)*
try = 'try' block catch+ | 'try' block catch* 'finally' block | 'try' '(' resource (';' resource)* ';'? ')' block catch* ('finally' block)?
resource = localvar | primary
catch = 'catch' '(' (annotation | 'final')* ctype ('|' ctype)* ident ')' block
switch = 'switch' '(' expr ')' '{{' arm* '}}'
arm = label ':' blockstmt* | label '->' (expr ';' | block | 'throw' expr ';')
label = 'case' cond (',' cond)* | 'default'
exprstmt = primary ('=' | ASSIGN) expr | '++' unary | '--' unary | postfix '++' | postfix '--' | call | new
expr = lambda | cond | primary ('=' | ASSIGN) expr
lambda = ident '->' lbody | '(' ')' '->' lbody | '(' ident (',' ident)* ')' '->' lbody | '(' params ')' '->' lbody
lbody = expr | block
cond = bin | bin '?' expr ':' cond | bin '?' expr ':' lambda
bin = unary | bin binop unary | bin 'instanceof' 'final'? type | bin 'instanceof' 'final'? type ident
binop = BIN | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | '+' | '-' | '*' | '/'
unary = ('+' | '-' | '!' | '~' | '++' | '--') unary | cast | postfix
cast = '(' type ('&' type)* ')' unary | '(' type ('&' type)* ')' lambda
postfix = primary | postfix '++' | postfix '--'
primary = LITERAL | STRING | ident | 'this' | 'super' | '(' expr ')' | primary '.' ident | primary '.' 'this' | primary '.' 'super' | primary '[' expr ']' | call | new
  | type '.' 'class' | 'void' '.' 'class' | primary '::' targs? (ident | 'new') | type '::' targs? (ident | 'new') | switch | newarray
call = ident args | primary '.' targs? ident args | 'this' args | 'super' args | primary '.' targs? 'super' args
args = '(' ')' | '(' expr (',' expr)* ')'
new = 'new' targs? annotation* ctype args classbody? | primary '.' 'new' ctype args classbody?
newarray = 'new' (PRIMITIVE | ctype) dimexpr+ dims? | 'new' (PRIMITIVE | ctype) dims '{{' (init (',' init)*)? ','? '}}'
dimexpr = '[' expr ']'
"""
