"""The grammars. What only binds operators tighter is flattened: acceptance doesn't depend on it."""

JSON = """
file = value EOF
value = object | array | STR | NUM | 'true' | 'false' | 'null'
object = '{' (member (',' member)*)? '}'
member = STR ':' value
array = '[' (value (',' value)*)? ']'
"""

TOML = """
file = NL* (line NL+)* EOF
line = table | pair
table = '[' '[' key ']' ']' | '[' key ']'
key = part ('.' part)*
part = BARE | STR
pair = key '=' value
value = STR | MSTR | VALUE | array | inline
array = '[' (value (',' value)* ','?)? ']'
inline = '{' NL* (pair NL* (',' NL* pair NL*)* (',' NL*)?)? '}'
"""

YAML = """
file = DOC* (node? DOC+)* node? EOF
node = SCALAR | flow | block
block = INDENT (map | seq) DEDENT
map = entry+
entry = KEY (SCALAR | flow | block)?
seq = dash+
dash = DASH (SCALAR | flow | block)?
flow = '[' (item (',' item)* ','?)? ']' | '{' (pair (',' pair)* ','?)? '}'
item = '?'? plain (':' plain?)? | ':' plain?
pair = '?'? plain (':' plain?)? | ':' plain?
plain = FLOW | flow
"""

PYTHON = """
file = (NEWLINE | statement)* EOF
statement = compound | simples
simples = simple (';' simple)* ';'? NEWLINE
simple = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'del' targets
    | 'assert' expr (',' expr)? | import | alias | assignment | exprs
import = 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' ('.' | '...')* ('import' names | dotted 'import' names)
names = '*' | '(' one (',' one)* ','? ')' | one (',' one)*
one = NAME ('as' NAME)?
dotted = NAME ('.' NAME)*
alias = "type" NAME tparams? '=' expr
assignment = single ':' expr ('=' (yield | exprs))? | single augmented (yield | exprs) | (targets '=')+ (yield | exprs) !'='
augmented = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//=' | '@='
@single = primary &tail | NAME
tail = ':' | '=' | augmented | ',' | 'in' | ')' | ']' | NEWLINE | ';'
targets = target (',' target)* ','?
@target = '*'? atarget
atarget = '(' targets? ')' &tail | '[' targets? ']' &tail | '(' atarget ')' | place
place = NAME !more | atom (trailer &more)* ('.' NAME | '[' slices ']')
more = '.' | '[' | '('
yield = 'yield' ('from' expr | exprs)?
exprs = yield | star (',' star)* ','?
star = '*' binary | named
named = NAME ':=' expr | expr
@expr = lambda | logic ('if' logic 'else' expr)?
lambda = 'lambda' lparams? ':' expr
lparams = lparam (',' lparam)* ','?
lparam = '**' NAME | '*' NAME? | '/' | NAME ('=' expr)?
logic = negated (('and' | 'or') negated)*
negated = 'not'* compare
compare = binary (comparison binary)*
comparison = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'not' 'in' | 'in' | 'is' 'not' | 'is'
binary = unary (operator unary)*
operator = '+' | '-' | '*' | '/' | '%' | '**' | '//' | '<<' | '>>' | '&' | '|' | '^' | '@'
unary = ('+' | '-' | '~')* 'await'? primary
@primary = atom trailer*
trailer = '.' NAME | '(' arguments? ')' | '[' slices ']'
atom = NAME | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' yield ')' | '(' star (clauses | (',' star)* ','?) ')' | '[' ']' | '[' star (clauses | (',' star)* ','?) ']' | braces
braces = '{' '}' | '{' pair (clauses | (',' pair)* ','?) '}' | '{' star (clauses | (',' star)* ','?) '}'
pair = '**' binary | expr ':' expr
clauses = clause+
clause = 'async'? 'for' targets 'in' logic ('if' condition)*
condition = NAME ':=' expr | logic | lambda
arguments = argument (',' argument)* ','?
argument = '**' expr | '*' expr | NAME '=' expr | named clauses?
slices = slice (',' slice)* ','?
slice = expr? ':' expr? (':' expr?)? | '*' binary | named
compound = if | while | for | try | with | funcdef | classdef | decorated | 'async' (funcdef | with | for) | match
if = 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
while = 'while' named ':' suite ('else' ':' suite)?
for = 'for' targets 'in' exprs ':' suite ('else' ':' suite)?
try = 'try' ':' suite (except+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
except = 'except' '*'? (expr (',' expr)* ('as' NAME)?)? ':' suite
with = 'with' ('(' item (',' item)* ','? ')' ':' | item (',' item)* ':') suite
item = expr ('as' target)?
decorated = ('@' named NEWLINE)+ ('async'? funcdef | classdef)
funcdef = 'def' NAME tparams? '(' params? ')' ('->' exprs)? ':' suite
params = param (',' param)* ','?
param = '**' NAME (':' expr)? | '*' (NAME (':' star)?)? | '/' | NAME (':' expr)? ('=' expr)?
tparams = '[' tparam (',' tparam)* ','? ']'
tparam = ('*' | '**')? NAME (':' expr)? ('=' star)?
classdef = 'class' NAME tparams? ('(' arguments? ')')? ':' suite
suite = NEWLINE INDENT statement+ DEDENT | simples
match = "match" exprs ':' NEWLINE INDENT case+ DEDENT
case = "case" patterns ('if' named)? ':' suite
patterns = pattern (',' pattern)* ','?
@pattern = '*' NAME | orpattern ('as' NAME)?
orpattern = closed ('|' closed)*
closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (kwpattern (',' kwpattern)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (mapping (',' mapping)* ','?)? '}'
kwpattern = NAME '=' pattern | pattern
mapping = '**' NAME | closed ':' pattern
"""

_SCRIPT = """
file = statement* EOF
statement = block | vars | ';' | if | for | while | do | jump | switch | try | function | class | import | export | labelled<TS> | declaration</TS> | expression
block = '{' statement* '}'
eos = ';' | &'}' | &EOF | %nl
labelled = NAME ':' statement
vars = ('var' | 'const' !'enum' | "let" &(NAME | '[' | '{')) declarator (',' declarator)* eos
declarator = binding <TS>'!'? annotation? </TS>('=' assign)?
binding = NAME | '[' element? (',' element?)* ']' | '{' (property (',' property)* ','?)? '}'
element = '...' binding | binding ('=' assign)?
property = '...' binding | propname ':' binding ('=' assign)? | NAME ('=' assign)?
if = 'if' '(' exprs ')' statement ('else' statement)?
for = 'for' "await"? '(' forhead ')' statement
forhead = ('var' | 'const' | "let") binding<TS> annotation?</TS> ("of" assign | 'in' exprs) | (('var' | 'const' | "let" &(NAME | '[' | '{')) declarator (',' declarator)* | exprs)? ';' exprs? ';' exprs? | call ("of" assign | 'in' exprs) | exprs
while = 'while' '(' exprs ')' statement
do = 'do' statement 'while' '(' exprs ')' ';'?
jump = ('continue' | 'break') (!%nl NAME)? eos | 'return' (!%nl exprs)? eos | 'throw' !%nl exprs eos | 'debugger' eos
switch = 'switch' '(' exprs ')' '{' ('case' exprs ':' statement* | 'default' ':' statement*)* '}'
try = 'try' block ('catch' ('(' binding<TS> annotation?</TS> ')')? block ('finally' block)? | 'finally' block)
function = ("async" !%nl)? 'function' '*'? NAME <TS>generics? </TS>params <TS>returns? </TS>body
body = block<TS> | eos</TS>
expression = !('function' | 'class' | '{') exprs eos
exprs = assign (',' assign)*
@assign = arrow | "yield" !'=' ('*'? (!%nl assign)?) &(')' | ']' | '}' | ',' | ';' | ':' | EOF | %nl) | binary ('?' assign ':' assign | assigning assign)?
assigning = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>'? '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow = ("async" !%nl)? (NAME | <TS>generics? </TS>params<TS> returns?</TS>) !%nl '=>' (block | !'{' assign)
binary = unary (operator unary<TS> | !%nl ("as" | "satisfies") ('const' | type)</TS>)*
operator = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<=' | '>=' | '<<' | '<' | '>' '>'? '>'? | '&&' | '||' | '??' | '&' | '|' | '^' | 'in' | 'instanceof'
unary = ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete')* ("await" !%nl unary | call (!%nl ('++' | '--'))?)
call = primary suffix*
suffix = '.' (%word | PRIVATE) | '?.' (%word | PRIVATE | '[' exprs ']' | arguments | template) | '[' exprs ']' | arguments | template<TS> | !%nl '!' !'=' | targs &('(' | TPL | TPL0)</TS>
primary = 'this' | 'super' | function_ | NAME | NUM | STR | REGEX | template | 'null' | 'true' | 'false' | array | object | '(' exprs ')' | class_ | new | 'import' ('.' NAME | '(' assign (',' assign)? ','? ')') | PRIVATE &'in'
function_ = ("async" !%nl)? 'function' '*'? NAME? <TS>generics? </TS>params <TS>returns? </TS>block
new = 'new' ('.' NAME | (new | maker) arguments?)
maker = primary ('.' (%word | PRIVATE) | '[' exprs ']')*<TS> targs?</TS>
template = TPL | TPL0 exprs (TPL1 exprs)* TPL2
arguments = '(' (argument (',' argument)* ','?)? ')'
argument = '...'? assign
array = '[' ','* (argument (','+ argument)* ','*)? ']'
object = '{' (member (',' member)* ','?)? '}'
member = '...' assign | method | propname ':' assign | NAME ('=' assign)?
method = ("async" !%nl)? '*'? propname callable | ("get" | "set") propname callable
callable = <TS>'?'? generics? </TS>params <TS>returns? </TS>body
propname = %word | PRIVATE | STR | NUM | '[' assign ']'
params = '(' (param (',' param)* ','?)? ')'
param = <TS>decorator* (modifier &(%word | '[' | '{'))* ('this' annotation | </TS>'...'? binding <TS>'?'? annotation? </TS>('=' assign)?<TS>)</TS>
decorator = '@' ('(' exprs ')' | NAME ('.' %word)* arguments?)
class = decorator* <TS>"abstract"? </TS>class_
class_ = 'class' <TS>(!"implements" NAME)? generics? </TS><JS>NAME? </JS>('extends' call<TS> targs?</TS>)?<TS> ("implements" type (',' type)*)?</TS> '{' classmember* '}'
classmember = ';' | "static" block | decorator* (modifier !('(' | '=' | ';' | '}'<TS> | '?' | '!' | ':' | '<'</TS>))* (method | <TS>index | </TS>propname <TS>('?' | '!')? annotation? </TS>('=' assign)? eos)
modifier = "static"<TS> | "public" | "private" | "protected" | "abstract" | "override" | "readonly" | "declare" | "accessor"</TS>
import = 'import' STR attributes? eos | 'import' <TS>("type" !"from")? </TS>clause "from" STR attributes? eos<TS> | 'import' "type"? NAME '=' exprs eos</TS> | &('import' ('(' | '.')) expression
attributes = ('with' | "assert") object
clause = NAME (',' (star | named))? | star | named
star = '*' "as" NAME
named = '{' (specifier (',' specifier)* ','?)? '}'
specifier = <TS>("type" !("as" | ',' | '}'))? </TS>(%word | STR) ("as" (%word | STR))?
export = 'export' ('default' (class | &(("async" !%nl)? 'function') (function | function_) | <TS>interface | </TS>assign eos) | '*' ("as" (%word | STR))? "from" STR attributes? eos | <TS>"type"? </TS>named ("from" STR attributes?)? eos | vars | function | class<TS> | declaration | '=' exprs eos</TS>)
"""

_TYPES = """
annotation = ':' type
returns = ':' ("asserts" (NAME | 'this') ("is" type)? | (NAME | 'this') "is" type | type)
declaration = interface | "type" NAME generics? '=' type eos | 'const'? 'enum' NAME '{' (propname ('=' assign)? (',' propname ('=' assign)?)* ','?)? '}' | ("namespace" | "module") !%nl (NAME ('.' NAME)* | STR) (block | eos) | "global" block
    | "declare" !%nl (vars | function | class | declaration) | "abstract" class_
interface = "interface" NAME generics? ('extends' type (',' type)*)? shape
@type = union ('extends' union '?' type ':' type)?
union = ('|' | '&')? postfixed (('|' | '&') postfixed)*
postfixed = (("keyof" | "readonly" | "unique" | "infer") !('[' ']' | ',' | ')' | '>' | ';' | '='))* simple (!%nl '[' type? ']')*
simple = functype | 'typeof' (NAME | 'import' '(' STR ')') ('.' %word)* targs? | 'import' '(' STR ')' ('.' %word)* targs? | NAME ('.' %word)* targs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | TPL | TPL0 type (TPL1 type)* TPL2 | mapped | shape | '[' (tuple (',' tuple)* ','?)? ']' | '(' type ')'
tuple = '...'? (%word '?'? ':' type | type '?'?)
functype = ("abstract"? 'new')? generics? params '=>' ("asserts" NAME ("is" type)? | (NAME | 'this') "is" type | type)
mapped = '{' (('-' | '+')? "readonly")? '[' NAME 'in' type ("as" type)? ']' (('-' | '+')? '?')? (':' type)? ';'? '}'
shape = '{' (signature sep)* signature? '}'
sep = ';' | ',' | %nl | &'}'
signature = 'new'? generics? params returns? | "readonly"? '[' NAME ':' type ']' annotation? | ("readonly" !(':' | '?' | '('))? (("get" | "set") &(%word | STR))? propname '?'? (generics? params returns? | annotation?)
index = '[' NAME ':' type ']' annotation eos
targs = '<' type (',' type)* '>'
generics = '<' generic (',' generic)* ','? '>'
generic = ('const' | 'in' | "out")* NAME ('extends' type)? ('=' type)?
"""


def _pick(keep: str, drop: str) -> str:
    import re

    out = re.sub(rf"<{drop}>.*?</{drop}>", "", _SCRIPT, flags=re.S)
    return re.sub(rf"</?{keep}>", "", out)


JAVASCRIPT = _pick("JS", "TS")
TYPESCRIPT = _pick("TS", "JS") + _TYPES

JAVA = """
file = (annotation* 'package' qualified ';')? ';'* (import ';'*)* (typedecl ';'*)* EOF
qualified = NAME ('.' NAME)*
import = 'import' 'static'? qualified ('.' '*')? ';'
typedecl = modifier* (class | interface | enum | record | '@' 'interface' NAME '{' annmember* '}')
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | "sealed" | "non" '-' "sealed"
annotation = '@' qualified ('(' ((NAME '=' annvalue (',' NAME '=' annvalue)*) | annvalue)? ')')?
annvalue = annotation | '{' (annvalue (',' annvalue)* ','?)? '}' | ternary
class = 'class' NAME tparams? ('extends' type)? ('implements' types)? ("permits" types)? body
interface = 'interface' NAME tparams? ('extends' types)? ("permits" types)? body
enum = 'enum' NAME ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant = annotation* NAME arguments? body?
record = "record" NAME tparams? '(' parameters? ')' ('implements' types)? body
body = '{' member* '}'
annmember = ';' | modifier* type NAME '(' ')' ('default' annvalue)? ';' | member
member = ';' | 'static'? block | typedecl | modifier* tparams? (ctor | method | field)
ctor = NAME ('(' parameters? ')' throws?)? block
method = ('void' | type) NAME '(' parameters? ')' dims throws? (block | ';')
field = type variable (',' variable)* ';'
throws = 'throws' types
variable = NAME dims ('=' initial)?
initial = '{' (initial (',' initial)* ','?)? '}' | expr
dims = (annotation* '[' ']')*
parameters = parameter (',' parameter)*
parameter = modifier* type (annotation* '...')? (NAME dims | (NAME '.')? 'this')
types = type (',' type)*
@type = annotation* (primitive | NAME targs? ('.' annotation* NAME targs?)*) dims
primitive = 'int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean'
targs = '<' (targ (',' targ)*)? '>'
targ = annotation* '?' (('extends' | 'super') type)? | type
tparams = '<' tparam (',' tparam)* '>'
tparam = annotation* NAME ('extends' type ('&' type)*)?
block = '{' statement* '}'
statement = block | ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' forhead ')' statement | switch | 'return' expr? ';' | 'throw' expr ';' | 'break' NAME? ';' | 'continue' NAME? ';'
    | 'synchronized' '(' expr ')' block | try | 'assert' expr (':' expr)? ';' | "yield" !('=' | '.' | '(' | '++' | '--') expr ';' | typedecl | local ';' | NAME ':' statement | effect ';'
effect = ('++' | '--') unary | postfix (assigning expr | '++' | '--') | &(postfix ';') made
made = calling | 'new' creator suffix*
calling = primary suffix*
local = modifier* type variable (',' variable)*
forhead = modifier* type NAME dims ':' expr | (local | effects)? ';' expr? ';' effects?
effects = expr (',' expr)*
switch = 'switch' '(' expr ')' '{' (label+ statement* | arm)* '}'
label = ('case' pattern (',' pattern)* | 'default') ':'
arm = ('case' pattern (',' pattern)* ('default')? | 'default') '->' (block | 'throw' expr ';' | expr ';')
pattern = 'default' | modifier* type (NAME | '(' (pattern (',' pattern)*)? ')' NAME?) guard? | ternary
guard = "when" expr
try = 'try' (('(' resource (';' resource)* ';'? ')') block catch* ('finally' block)? | block (catch+ ('finally' block)? | 'finally' block))
resource = local | postfix
catch = 'catch' '(' modifier* type ('|' type)* NAME ')' block
@expr = lambda | ternary (assigning expr)?
assigning = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '>=' | '>' '>='
lambda = (NAME | '(' (NAME (',' NAME)* | parameters)? ')') '->' (block | expr)
ternary = binary ('?' (lambda | ternary) ':' (lambda | ternary))?
binary = unary (operator unary | 'instanceof' instance)*
instance = 'final'? type ('(' (pattern (',' pattern)*)? ')' | NAME)?
operator = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<=' | '>=' | '<<' | '<' | '>' '>'? '>'? | '&&' | '||' | '&' | '|' | '^'
@unary = ('+' | '-' | '!' | '~' | '++' | '--') unary | cast | postfix ('++' | '--')*
cast = '(' primitive dims ')' unary | '(' type ('&' type)* ')' &(NAME | STR | NUM | '(' | '!' | '~' | 'this' | 'super' | 'new' | 'true' | 'false' | 'null' | 'switch' | primitive) (lambda | unary)
postfix = primary suffix*
suffix = '.' (targs? NAME arguments? | 'this' | 'super' (arguments | '.' NAME arguments? | '::' NAME)? | 'class' | 'new' creator | targs 'super' arguments) | '[' expr ']' | '::' (targs? NAME | 'new')
primary = type '::' ('new' | targs? NAME) | (primitive | NAME ('.' NAME)*) ('[' ']')+ '.' 'class' | primitive '.' 'class' | 'void' '.' 'class' | NUM | STR | 'true' | 'false' | 'null' | 'this' arguments? | 'super' (arguments | '.' targs? NAME arguments? | '::' NAME) | 'new' creator | switch | '(' expr ')' | NAME arguments?
creator = annotation* (NAME targs? ('.' NAME targs?)* | primitive) (('[' expr ']')+ dims | dims '{' (initial (',' initial)* ','?)? '}' | arguments body?)
arguments = '(' (expr (',' expr)*)? ')'
"""

GO = """
file = 'package' NAME end (import end)* (top end)* EOF
end = ';' | &'}' | &')' | &EOF
import = 'import' (spec | '(' (spec end)* ')')
spec = (NAME | '.')? STR
top = func | declaration
declaration = 'const' (constspec | '(' (constspec end)* ')') | 'var' (varspec | '(' (varspec end)* ')') | 'type' (typespec | '(' (typespec end)* ')')
constspec = idents (type? '=' exprs)?
varspec = idents (type ('=' exprs)? | '=' exprs)
typespec = NAME (tparams type | '='? type)
tparams = '[' NAME (',' NAME)* constraint (',' NAME (',' NAME)* constraint)* ','? ']'
constraint = term ('|' term)*
term = '~'? type
idents = NAME (',' NAME)*
func = 'func' ('(' (NAME? '*'? qualified targs? | NAME '*'? qualified targs?) ','? ')' NAME | NAME tparams?) signature block?
signature = params (params | type)?
params = '(' (param (',' param)* ','?)? ')'
param = NAME '...'? type | '...'? type
@type = qualified targs? | '*' type | '[' ']' type | '[' ('...' | expr) ']' type | 'map' '[' type ']' type | '<-' 'chan' type | 'chan' '<-'? type | 'func' signature | struct | 'interface' '{' (element end)* '}' | '(' type ')'
qualified = NAME ('.' NAME)?
targs = '[' type (',' type)* ','? ']'
struct = 'struct' '{' (fielddecl end)* '}'
fielddecl = (NAME (',' NAME)* type | '*'? qualified targs?) STR?
element = NAME signature | constraint
block = '{' statements '}'
statements = (statement? end2)*
end2 = ';' | &'}' statement? never | statementlast
never = !NAME NAME
statementlast = never
statement = declaration | labelled | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | switch | select | for
labelled = NAME ':' !'=' statement?
simple = exprs (assigning (exprs | 'range' expr) | ':=' ('range' expr | exprs) | '++' | '--' | '<-' expr)?
assigning = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '&^='
xsimple = xexprs (assigning xexprs | ':=' xexprs | '++' | '--' | '<-' xexpr)?
if = 'if' (xsimple? ';')? xexpr block ('else' (if | block))?
switch = 'switch' (xsimple? ';')? (xsimple)? '{' (('case' casetypes | 'default') ':' inner)* '}'
casetypes = cased (',' cased)*
cased = type &(',' | ':') | expr
inner = (!('case' | 'default' | '}') (';' | statement end))*
select = 'select' '{' (('case' simple | 'default') ':' inner)* '}'
for = 'for' (range | xsimple? ';' xexpr? ';' xsimple? | xexpr)? block
range = (xexprs (':=' | '='))? 'range' xexpr
exprs = expr (',' expr)*
xexprs = xexpr (',' xexpr)*
operator = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<=' | '>=' | '<<' | '<' | '>' '>'? | '&&' | '||' | '&^' | '&' | '|' | '^'
sign = '+' | '-' | '!' | '^' | '*' | '&' | '<-'
@expr = unary (operator unary)*
unary = sign* primary
primary = operand (suffix | literal)*
@xexpr = xunary (operator xunary)*
xunary = sign* xprimary
xprimary = xoperand suffix*
suffix = '.' (NAME | '(' ('type' | type) ')') | '[' (expr? ':' expr? (':' expr)? | exprs ','? | type (',' type)* ','?) ']' | '(' (arg (',' arg)* '...'? ','?)? ')'
arg = expr &(',' | ')' | '...') | type
operand = NUM | STR | composite | NAME | '(' (expr | type) ')' | 'func' signature block | conversion
xoperand = NUM | STR | ('[' | 'map') &NAME composite | composite2 | NAME | '(' (expr | type) ')' | 'func' signature block | conversion
conversion = ('[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{' '}' | '*' type) &'('
composite = (struct | '[' ('...' | expr)? ']' type | 'map' '[' type ']' type | qualified targs? &'{') literal
composite2 = (struct | '[' ('...' | expr)? ']' type | 'map' '[' type ']' type) literal
literal = '{' (keyed (',' keyed)* ','?)? '}'
keyed = (literal | expr) (':' (literal | expr))?
""".replace("statements = (statement? end2)*\nend2 = ';' | &'}' statement? never | statementlast\nnever = !NAME NAME\nstatementlast = never\n", "statements = (';' | statement end)*\n")

C = """
file = (external | ';')* EOF
external = function | declaration | static_assert
static_assert = '_Static_assert' '(' expr (',' STR+)? ')' ';'
function = specifiers declarator attribute* declaration* block
declaration = specifiers (init (',' init)*)? ';' | static_assert
specifiers = qualifier* (basic (basic | qualifier)* | (struct | enum) qualifier* | typeof qualifier* | NAME qualifier*)
qualifier = 'const' | 'volatile' | 'restrict' | '__restrict' | 'static' | 'extern' | 'typedef' | 'register' | 'auto' | 'inline' | '__inline' | '__inline__' | '_Noreturn' | '_Thread_local' | '_Atomic' | '__extension__' | attribute | '_Alignas' '(' (typename | expr) ')'
attribute = '__attribute__' '(' '(' (attr (',' attr)*)? ')' ')'
attr = (NAME | 'const') ('(' (expr (',' expr)*)? ')')?
basic = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
typeof = "typeof" '(' (typename | expr) ')' | "__typeof__" '(' (typename | expr) ')'
struct = ('struct' | 'union') attribute* (NAME? '{' (field | ';' | static_assert)* '}' attribute* | NAME)
field = specifiers (fielded (',' fielded)*)? ';'
fielded = declarator? (':' ternary)? attribute*
enum = 'enum' attribute* (NAME? '{' constant (',' constant)* ','? '}' | NAME)
constant = NAME ('=' ternary)?
init = declarator ("asm" '(' STR+ ')')? attribute* ('=' initial)?
initial = '{' (designated (',' designated)* ','?)? '}' | assign
designated = (designator+ '=')? initial
designator = '[' ternary ('...' ternary)? ']' | '.' NAME
declarator = ('*' qualifier*)* attribute* direct
direct = (NAME | '(' declarator ')') ('[' qualifier* (assign | '*')? ']' | '(' parameters? ')')*
parameters = parameter (',' parameter)* (',' '...')? | NAME (',' NAME)*
parameter = specifiers (declarator | abstract)? attribute*
abstract = ('*' qualifier*)+ abstracted? | abstracted
abstracted = ('(' abstract ')' | '[' qualifier* (assign | '*')? ']' | '(' parameters? ')')+
typename = specifiers abstract?
block = '{' (local | statement)* '}'
local = declaration
statement = block | ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' (declaration | expr? ';') expr? ';' expr? ')' statement | 'switch' '(' expr ')' statement
    | 'case' ternary ('...' ternary)? ':' statement | 'default' ':' statement | 'goto' ('*'? NAME) ';' | 'continue' ';' | 'break' ';' | 'return' expr? ';' | asm | NAME ':' attribute* (statement | &'}') | expr ';'
asm = ('asm' | '__asm__') ('volatile' | 'goto')? '(' STR+ (':' operands?)* ')' ';'
operands = oper (',' oper)*
oper = ('[' NAME ']')? STR+ ('(' expr ')')?
expr = assign (',' assign)*
@assign = ternary (assigning assign)?
assigning = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
ternary = binary ('?' expr? ':' ternary)?
binary = unary (operator unary)*
operator = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<=' | '>=' | '<<' | '<' | '>' '>'? | '&&' | '||' | '&' | '|' | '^'
@unary = ('++' | '--' | '+' | '-' | '!' | '~' | '*' | '&' | '&&' | '__extension__') unary | 'sizeof' ('(' typename ')' !'{' | unary) | '_Alignof' '(' typename ')' | cast | postfix
cast = '(' typename ')' (unary | '{' (designated (',' designated)* ','?)? '}' tail*)
postfix = primary tail*
tail = '[' expr ']' | '(' (argument (',' argument)*)? ')' | '.' NAME | '->' NAME | '++' | '--'
argument = assign &(',' | ')') | typename
primary = NAME STR* (NAME? STR+)* | NUM | STR (STR | NAME !('(' | '='))* | '(' expr ')' | '(' block ')' | '_Generic' '(' assign (',' (typename | 'default') ':' assign)+ ')'
"""

RUST = """
file = inner* item* EOF
inner = '#' '!' tree
outer = '#' tree
tree = '[' any* ']' | '(' any* ')' | '{' any* '}'
any = tree | !(']' | ')' | '}' | EOF) token
token = NAME | NUM | STR | LIFETIME | %word | '...' | '=>' | '->' | '::' | '<-' | '..=' | '..' | '==' | '!=' | '<=' | '>=' | '&&' | '||' | '++' | '--' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '<<' | ':=' | '+' | '-' | '*' | '/' | '%' | '=' | '<' | '>' | '!' | '~' | '^' | '&' | '|' | '?' | ':' | ';' | ',' | '.' | '@' | '#' | '$'
item = outer* visibility? plainitem
visibility = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?
plainitem = use | function | struct | enum | "union" NAME generics? where? fields | const | static | trait | impl | mod | alias | externs | macro
use = 'use' usetree ';'
usetree = '::'? (usesegment '::')* ('*' | '{' (usetree (',' usetree)* ','?)? '}' | usesegment ('as' NAME)?)
usesegment = NAME | 'self' | 'super' | 'crate' | 'Self'
function = ('const' | 'async' | 'unsafe' | "safe" | 'extern' STR?)* 'fn' NAME generics? '(' params? ')' ('->' type)? where? (block | ';')
params = param (',' param)* ','?
param = outer* (self | pattern ':' type | '...')
self = '&'? LIFETIME? 'mut'? 'self' (':' type)?
struct = 'struct' NAME generics? (where? fields | '(' (tuplefield (',' tuplefield)* ','?)? ')' where? ';' | where? ';')
fields = '{' (field (',' field)* ','?)? '}'
field = outer* visibility? NAME ':' type
tuplefield = outer* visibility? type
enum = 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}'
variant = outer* visibility? NAME (fields | '(' (tuplefield (',' tuplefield)* ','?)? ')')? ('=' expr)?
const = 'const' NAME ':' type ('=' expr)? ';'
static = 'static' 'mut'? NAME ':' type ('=' expr)? ';'
trait = 'unsafe'? "auto"? 'trait' NAME generics? (':' bounds)? where? '{' inner* item* '}'
impl = 'unsafe'? 'impl' (generics !('::'))? '!'? type ('for' type)? where? '{' inner* item* '}'
mod = 'unsafe'? 'mod' NAME (';' | '{' inner* item* '}')
alias = 'type' NAME generics? (':' bounds?)? where? ('=' type)? where? ';'
externs = 'unsafe'? 'extern' ('crate' (NAME | 'self') ('as' NAME)? ';' | STR? '{' inner* item* '}')
macro = path '!' NAME? ('{' any* '}' | '(' any* ')' ';' | '[' any* ']' ';')
generics = '<' (generic (',' generic)* ','?)? '>'
generic = outer* (LIFETIME (':' lifetimes?)? | 'const' NAME ':' type ('=' (block | '-'? NUM | NAME | 'true' | 'false' | STR))? | NAME (':' bounds?)? ('=' type)?)
lifetimes = LIFETIME ('+' LIFETIME)*
where = 'where' (predicate (',' predicate)* ','?)?
predicate = LIFETIME ':' lifetimes? | forall? type ':' bounds?
forall = 'for' generics
bounds = bound ('+' bound)* '+'?
bound = LIFETIME | '(' bound ')' | ('?' | '~' 'const' | 'const' | 'async')? forall? '?'? path | 'use' generics
@type = '(' (type (',' type)* ','?)? ')' | '!' | '*' ('const' | 'mut') type | ('&&' | '&') LIFETIME? 'mut'? type | '[' type (';' expr)? ']' | forall? ('unsafe' | 'extern' STR?)* 'fn' '(' (outer* (NAME ':')? type (',' outer* (NAME ':')? type)* ','? | '...')? ')' ('->' type)? | ('dyn' | 'impl') bounds | path '!' tree | forall? path ('+' bounds)? | "_"
path = ('<' type ('as' type)? '>' '::')? '::'? segment ('::' segment)*
segment = (NAME | 'self' | 'Self' | 'super' | 'crate') ('::'? args | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
args = '<' (arg (',' arg)* ','?)? '>'
arg = LIFETIME | NAME args? ('=' | ':') (type | bounds) | type | block | '-'? NUM | STR | 'true' | 'false'
block = LIFETIME? ('{' inner* statement* '}')
statement = ';' | outer* let | item | outer* blockexpr !('.' | '?' | tailop) | outer* expr (';' | &'}')
tailop = '(' never
never = !';' ';'
let = 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blockexpr = (LIFETIME ':')? ('if' ifrest | 'match' xexpr '{' inner* (armlist)? '}' | 'loop' block | 'while' condition block | 'for' pattern 'in' xexpr block | 'unsafe' block | 'async' 'move'? block | 'const' block | block) | path '!' '{' any* '}'
ifrest = condition block ('else' (block | 'if' ifrest))?
condition = cond ('&&' cond)*
cond = 'let' pattern '=' xexpr | xexpr
armlist = arm*
arm = outer* pattern ('if' condition2)? '=>' (blockexpr (',' | &'}') | blockexpr !('.' | '?' | operator) | expr (',' | &'}'))
condition2 = ('let' pattern '=' expr | expr)
@pattern = '|'? pat ('|' pat)*
pat = '..' | ('ref'? 'mut'? NAME !('::' | '(' | '{' | '!' | '..=' | '..')) ('@' pat)? | ('&&' | '&') 'mut'? pat | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | path '!' tree | path ('(' (pattern (',' pattern)* ','?)? ')' | '{' (patfield (',' patfield)* ','?)? '}')? (('..=' | '..') bound2?)? | literal (('..=' | '...' | '..') bound2?)? | ('..=' ) bound2 | 'const' block
bound2 = literal | path
patfield = outer* ('..' | (NAME | NUM) ':' pattern | 'ref'? 'mut'? NAME)
literal = '-'? NUM | STR | 'true' | 'false'
operator = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '=' | '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<=' | '>=' | '<<' | '<' | '>' '>'? '='? | '&&' | '||' | '&' | '|' | '^'
sign = '-' | '!' | '*' | ('&&' | '&') ("raw" ('const' | 'mut') | 'mut')?
@expr = range | unary (operator unary)* (('..=' | '..') (unary (operator unary)*)?)?
range = ('..=' | '..') (unary (operator unary)*)?
unary = sign* postfix ('as' type)*
postfix = primary suffix*
suffix = '?' | '.' ('await' | NUM | NAME ('::' args)?) | '(' (outer* expr (',' outer* expr)* ','?)? ')' | '[' expr ']'
primary = NUM | STR | 'true' | 'false' | closure | jump | path '!' tree | structlit | blockexpr | path | '(' (outer* expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']'
structlit = path '{' (fieldinit (',' fieldinit)* ','?)? '}'
fieldinit = outer* ('..' expr? | (NAME | NUM) ':' expr | NAME)
closure = forall? 'static'? 'async'? 'move'? ('||' | '|' (closed (',' closed)* ','?)? '|') ('->' type block | expr)
closed = outer* pat (':' type)?
jump = 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME?
@xexpr = xrange | xunary (operator xunary)* (('..=' | '..') (xunary (operator xunary)*)?)?
xrange = ('..=' | '..') (xunary (operator xunary)*)?
xunary = sign* xpostfix ('as' type)*
xpostfix = xprimary suffix*
xprimary = NUM | STR | 'true' | 'false' | closure | jump | path '!' tree | 'if' ifrest | 'match' xexpr '{' inner* (armlist)? '}' | 'unsafe' block | block | path | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']'
""".replace(" | tailop)", ")").replace("tailop = '(' never\nnever = !';' ';'\n", "")
