"""Parsing-expression grammars of eight languages, for :class:`codeloom.llm.peg.Grammar`.

They accept what the languages' grammars accept, names and types unchecked; precedence is left out, as it never decides
whether a text is valid. ``NLB`` matches nothing before a token that starts a line.
"""

from __future__ import annotations

import re
from functools import cache

from codeloom.llm import lexers
from codeloom.llm.peg import Grammar

JSON = """
file <- value EOF
value <~ object / array / STR / NUM / LIT
object <- '{' (STR ':' value (',' STR ':' value)*)? '}'
array <- '[' (value (',' value)*)? ']'
"""

TOML = """
file <- NL? (line NL)* EOF
line <~ '[[' key ']]' / '[' key ']' / key '=' value
key <~ KEY ('.' KEY)*
value <- VAL / array / table
array <- '[' (value (',' value)*)? ','? ']'
table <- '{' (key '=' value (',' key '=' value)*)? '}'
"""

PYTHON = """
file <- (stmt / NL)* EOF
stmt <~ compound / simple
simple <~ small (';' small)* ';'? NL
small <~ 'pass' / 'break' / 'continue' / 'return' stars? / 'raise' (expr ('from' expr)?)? / 'global' names / 'nonlocal' names
  / 'del' targets / 'assert' expr (',' expr)? / importing / 'type' name tparams? '=' expr / assignment / yielding / stars
importing <~ 'import' dotted ('as' name)? (',' dotted ('as' name)?)*
  / 'from' ('.' / '...')* (dotted / &'import') 'import' ('*' / '(' alias (',' alias)* ','? ')' / alias (',' alias)*)
alias <~ name ('as' name)?
dotted <~ name ('.' name)*
names <~ name (',' name)*
name <~ ID / 'match' / 'case' / 'type' / '_'
assignment <~ targets '=' (targets '=')* rhs / target augop rhs / (target / '(' target ')') ':' expr ('=' rhs)?
rhs <~ yielding / stars
augop <~ '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
targets <~ starred (',' starred)* ','?
starred <~ '*'? target
target <- place / name !tail / '(' targets? ')' !tail / '[' targets? ']' !tail
tail <~ '.' / '[' / '('
place <~ atom (trailer &tail)* ('.' name / '[' slices ']') !tail
compound <~ deco* (funcdef / classdef) / 'if' named block ('elif' named block)* ('else' block)? / 'while' named block ('else' block)?
  / 'async'? 'for' targets 'in' stars block ('else' block)? / 'async'? 'with' withs block / trying / matching
deco <~ '@' named NL
funcdef <~ 'async'? 'def' name tparams? '(' params? ')' ('->' expr)? block
tparams <~ '[' ('*' / '**')? name (':' expr)? ('=' expr)? (',' ('*' / '**')? name (':' expr)? ('=' expr)?)* ','? ']'
params <~ param (',' param)* ','?
param <~ '/' / '**' name (':' expr)? / '*' (name (':' stare)?)? / name (':' expr)? ('=' expr)?
stare <~ '*'? expr
classdef <~ 'class' name tparams? ('(' args? ')')? block
block <~ ':' (NL INDENT (stmt)+ DEDENT / simple)
withs <~ '(' withitem (',' withitem)* ','? ')' &':' / withitem (',' withitem)*
withitem <~ expr ('as' starred)?
trying <~ 'try' block (('except' '*'? (expr (',' expr)* ('as' name)?)? block)+ ('else' block)? ('finally' block)? / 'finally' block)
matching <~ 'match' stars ':' NL INDENT ('case' pats ('if' named)? block)+ DEDENT
pats <~ pat (',' pat)* ','?
pat <- '*' name / pator ('as' name)?
pator <~ patone ('|' patone)*
patone <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / '(' pats? ')' / '[' pats? ']' / '{' (patkv (',' patkv)* ','?)? '}' / dotted ('(' (patarg (',' patarg)* ','?)? ')')?
patkv <~ '**' name / pator ':' pat
patarg <~ name '=' pat / pat
stars <- star (',' star)* ','?
star <~ '*' bitor / named
named <- name ':=' expr / expr
expr <- 'lambda' lparams? ':' expr / bool ('if' bool 'else' expr)?
lparams <~ lparam (',' lparam)* ','?
lparam <~ '/' / '**' name / '*' name? / name ('=' expr)?
bool <- notted (('and' / 'or') notted)*
notted <~ 'not'* compare
compare <~ bitor (compop bitor)*
compop <~ '<' / '>' / '==' / '>=' / '<=' / '!=' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
bitor <- unary (binop unary)*
binop <~ '+' / '-' / '*' / '/' / '//' / '%' / '@' / '|' / '&' / '^' / '<<' / '>>' / '**'
unary <~ ('-' / '+' / '~')* 'await'? atom trailer*
trailer <~ '.' name / '(' args? ')' / '[' slices ']'
args <~ arg (',' arg)* ','?
arg <~ '**' expr / '*' expr / name '=' expr / named comp*
slices <~ slice (',' slice)* ','?
slice <~ expr? ':' expr? (':' expr?)? / star
atom <- name / NUM / STR+ / 'None' / 'True' / 'False' / '...' / '(' (yielding / star (comp+ / (',' star)* ','?))? ')' / '[' (star (comp+ / (',' star)* ','?))? ']' / '{' (dictset)? '}'
dictset <~ kv (comp+ / (',' kv)* ','?) / star (comp+ / (',' star)* ','?)
kv <~ '**' bitor / expr ':' expr
comp <~ 'async'? 'for' targets 'in' bool ('if' named_nocond)*
named_nocond <~ name ':=' bool / bool / 'lambda' lparams? ':' expr
yielding <~ 'yield' ('from' expr / stars)?
"""

_ALL_WORDS = " / ".join(f"'{w}'" for w in sorted(lexers.JS_WORDS | lexers.JS_SOFT))
_TS_WORDS = " / ".join(f"'{w}'" for w in sorted(lexers.JS_WORDS | lexers.JS_SOFT | lexers.TS_SOFT))

# {t} is a type annotation, {r} a return type, {p} type parameters, {a} type arguments, {b} a body or nothing.
_SCRIPT = """
file <- stmt* EOF
eos <~ ';' / &'}' / &EOF / NLB
name <~ ID / {soft}
idname <~ ID / {words}
stmt <- block / vars eos / {ts_stmt} func / class / 'if' '(' expr ')' stmt ('else' stmt)? / 'for' 'await'? '(' forhead ')' stmt / 'while' '(' expr ')' stmt
  / 'do' stmt 'while' '(' expr ')' ';'? / 'return' (!NLB expr)? eos / ('break' / 'continue') (!NLB name)? eos / 'throw' expr eos / trying
  / 'switch' '(' expr ')' '{{' ('case' expr ':' stmt* / 'default' ':' stmt*)* '}}' / 'with' '(' expr ')' stmt / 'debugger' eos / ';' / importing / exporting / name ':' stmt / !block expr eos
block <- '{{' stmt* '}}'
vars <~ ('var' / 'const' / 'let' &binding) decl (',' decl)*
decl <~ binding {excl} {t} ('=' assign)?
binding <- name / '[' (',' / '...'? bindelem)* ']' / '{{' (bindprop (',' bindprop)* ','?)? '}}'
bindelem <~ binding ('=' assign)?
bindprop <~ '...' binding / propkey ':' bindelem / name ('=' assign)?
forhead <~ ('var' / 'const' / 'let') binding {t} ('of' assign / 'in' expr) / member ('of' assign / 'in' expr) / (vars / expr)? ';' expr? ';' expr?
trying <~ 'try' block ('catch' ('(' binding {t} ')')? block ('finally' block)? / 'finally' block)
func <- 'async'? 'function' '*'? name? {p} '(' params ')' {r} ({b})
params <- (param (',' param)*)? ','?
param <~ deco* {mods} ('...' / 'this' {t} / ) binding {opt} {t} ('=' assign)? / 'this' {t}
deco <~ '@' member
class <- deco* {abstract} 'class' (!('extends'{impl}) name)? {p} ('extends' member {a})? {impls} '{{' classitem* '}}'
classitem <~ ';' / 'static' block / deco* {mods} (('static' / 'accessor') {mods} &memberstart)? member_of
memberstart <~ '*' / '[' / '{{' / STR / NUM / PRIV / idname
member_of <~ {index} ('get' / 'set') &memberstart propkey {opt} '(' params ')' {r} ({b}) / ('async' !NLB &memberstart)? '*'? propkey {opt} {p} '(' params ')' {r} ({b}) / propkey {opt} {excl} {t} ('=' assign)? eos
propkey <- idname / STR / NUM / PRIV / '[' assign ']'
importing <~ 'import' {ts_import} (STR / importlist 'from' STR) (('with' / 'assert_') object)? eos
importlist <~ name (',' (namespace_all / namedlist))? / namespace_all / namedlist
namespace_all <~ '*' 'as' name
namedlist <~ '{{' (named (',' named)* ','?)? '}}'
named <~ {ntype} (idname / STR) ('as' (idname / STR))?
exporting <~ deco* 'export' ('default' ({ts_default} func / class / assign eos) / {ts_export} '*' ('as' (idname / STR))? 'from' STR eos / namedlist ('from' STR)? eos / vars eos / func / class)
expr <- assign (',' assign)*
assign <- arrow / 'yield' (!NLB '*'? assign)? / cond (assignop assign)?
assignop <~ '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
arrow <~ ('async' !NLB)? (name '=>' / {p} '(' params ')' {ar} '=>') (block / assign)
cond <~ binary ('?' assign ':' assign)?
binary <- unary (binop unary {astype})*
binop <~ '+' / '-' / '*' / '/' / '%' / '**' / '==' / '===' / '!=' / '!==' / '<=' / '>=' / '<<' / '<' / '>' ('>' '>'?)? / '&&' / '||' / '??' / '&' / '|' / '^' / 'in' / 'instanceof'
unary <~ {cast} ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' !'=>' &operand)* postfix
operand <~ ID / NUM / STR / TPL / THEAD / REGEX / '(' / '[' / '{{' / 'this' / 'new' / 'function' / 'class' / 'import' / 'super' / {soft}
postfix <~ member (!NLB ('++' / '--'))? {astype}
member <- primary trailer*
trailer <~ '.' (idname / PRIV) / '?.' ('(' args ')' / '[' expr ']' / TPL / idname / PRIV / template) / '[' expr ']' / '(' args ')' / TPL / template / {tstrail}
args <- (arg (',' arg)*)? ','?
arg <~ '...'? assign
template <- THEAD expr (TMID expr)* TTAIL
primary <- 'new' ('.' idname / primary ('.' (idname / PRIV) / '[' expr ']' / TPL / template)* {a} ('(' args ')')?) / 'import' ('.' idname / &'(') / 'async' &'function' func / func / class / name / 'this' / 'super' / NUM / STR / REGEX / TPL / template / 'null' / 'true' / 'false' / array / object / '(' expr ')' / PRIV &'in'
array <- '[' (',' / arg &(',' / ']'))* ']'
object <- '{{' (prop (',' prop)* ','?)? '}}'
prop <~ '...' assign / ('get' / 'set') &memberstart propkey '(' params ')' {r} block / ('async' !NLB &memberstart)? '*'? propkey {p} '(' params ')' {r} block / propkey ':' assign / name ('=' assign)?
"""

_TYPES = """
type <- fntype / union ('extends' union '?' type ':' type)? / pred
pred <~ 'asserts'? (name / 'this') 'is' type
fntype <~ 'abstract'? 'new'? tparams? '(' params ')' '=>' rettype
rettype <~ 'asserts' (name / 'this') ('is' type)? / (name / 'this') 'is' type / type
union <- '|'? inter ('|' inter)*
inter <~ '&'? tprefix ('&' tprefix)*
tprefix <~ ('keyof' &tstart / 'unique' &tstart / 'readonly' &tstart / 'infer' name ('extends' union !'?')?)* tpost / 'infer' name
tstart <~ '(' / '[' / '{' / STR / NUM / TPL / idname
tpost <- tprim (!NLB '[' type? ']')*
tprim <~ '(' type ')' / '[' (tupel (',' tupel)* ','?)? ']' / mapped / '{' tmember* '}' / 'typeof' ('import' '(' type ')' / 'this' / name) ('.' (idname / PRIV))* targs? / 'import' '(' type ')' ('.' idname)* targs? / '-'? NUM / STR / TPL / THEAD type (TMID type)* TTAIL / 'this' / 'void' / 'null' / 'true' / 'false' / fntype / tentity targs?
tentity <~ (name / 'void') ('.' idname)*
tupel <~ '...'? (idname '?'? ':' type / type '?'?)
mapped <~ '{' (('+' / '-')? 'readonly')? '[' name 'in' type ('as' type)? ']' (('+' / '-')? '?')? (':' type)? ';'? '}'
tmember <~ (';' / ',') / (fnsig / 'new' fnsig / ('readonly' &memberstart)? index_sig / ('get' / 'set') &memberstart propkey '(' params ')' (':' rettype)? / ('readonly' &memberstart)? propkey '?'? (tparams? '(' params ')' (':' rettype)? / (':' type)?)) (';' / ',' / &'}' / NLB)
fnsig <~ tparams? '(' params ')' (':' rettype)?
index_sig <~ '[' name ':' type ']' ':' type
targs <- '<' type (',' type)* '>'
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <~ ('const' / 'in' / 'out' &tparamname)* name ('extends' type)? ('=' type)?
tparamname <~ name
interface <~ 'interface' name tparams? ('extends' tentity targs? (',' tentity targs?)*)? '{' tmember* '}'
alias <~ 'type' name tparams? '=' type eos
enumdecl <~ 'const'? 'enum' name '{' (propkey ('=' assign)? (',' propkey ('=' assign)?)* ','?)? '}'
namespace <~ ('namespace' / 'module' / 'global') (name ('.' name)* / STR)? block
declaring <~ 'declare' (namespace / vars eos / func / class / interface / alias / enumdecl)
modifiers <~ (('public' / 'private' / 'protected' / 'readonly' / 'override' / 'abstract' / 'declare') &memberstart)*
"""


def _fill(text: str, **parts: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: parts[m.group(1)], text).replace("{{", "{").replace("}}", "}")


def _soft(words) -> str:
    return " / ".join(f"'{w}'" for w in sorted(words))


JAVASCRIPT = _fill(_SCRIPT, soft=_soft(lexers.JS_SOFT), words=_ALL_WORDS, ts_stmt="", excl="", t="", r="", p="", a="", b="block", mods="", opt="", abstract="", impl="", impls="", index="", ts_import="", ntype="", ts_default="", ts_export="", ar="", astype="", cast="", tstrail="PRIV PRIV")
JAVASCRIPT = JAVASCRIPT.replace("'assert_'", "'with'").replace("/ PRIV PRIV", "")
TYPESCRIPT = _fill(
    _SCRIPT,
    soft=_soft(lexers.JS_SOFT | lexers.TS_SOFT), words=_TS_WORDS, ts_stmt="interface / alias / enumdecl / namespace / declaring /", excl="'!'?", t="(':' type)?", r="(':' rettype)?", p="tparams?", a="targs?",
    b="block / eos", mods="modifiers", opt="'?'?", abstract="'abstract'?", impl=" / 'implements'", impls="('implements' tentity targs? (',' tentity targs?)*)?", index="index_sig eos / ",
    ts_import="('type' !'from' &(name / '*' / '{'))?", ntype="('type' !('as' / ',' / '}'))?", ts_default="interface /", ts_export="'=' expr eos / 'as' 'namespace' name eos / 'type' (namedlist ('from' STR)? eos / '*' ('as' idname)? 'from' STR eos) / interface / alias / enumdecl / namespace / declaring / 'import' name '=' member eos /", ar="(':' rettype)?",
    astype="(!NLB ('as' / 'satisfies') type)*", cast="('<' type '>' &operand)?", tstrail="!NLB '!' / targs &('(' / TPL / THEAD)",
) + _TYPES
TYPESCRIPT = TYPESCRIPT.replace("'assert_'", "'asserts'")

JAVA = """
file <- (annotation* 'package' qname ';')? (importing / ';')* (typedecl / ';')* EOF
importing <~ 'import' 'static'? qname ('.' '*')? ';'
name <~ ID / 'var' / 'record' / 'sealed' / 'permits' / 'yield' / 'when' / 'module' / 'open'
qname <~ name ('.' name)*
annotation <- '@' !'interface' qname ('(' (name '=' elemvalue (',' name '=' elemvalue)* / elemvalue)? ')')?
elemvalue <~ annotation / arrayinit / cond
modifiers <- (annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &modnext / ID '-' 'sealed')*
modnext <~ 'class' / 'interface' / 'abstract' / 'public' / 'static' / 'final'
typedecl <~ modifiers (classdecl / interfacedecl / enumdecl / recorddecl / annodecl)
classdecl <~ 'class' name tparams? ('extends' type)? ('implements' types)? ('permits' types)? body
interfacedecl <~ 'interface' name tparams? ('extends' types)? ('permits' types)? body
enumdecl <~ 'enum' name ('implements' types)? '{' (enumconst (',' enumconst)*)? ','? (';' member*)? '}'
enumconst <~ annotation* name ('(' args ')')? body?
recorddecl <~ 'record' name tparams? '(' (modifiers type '...'? name (',' modifiers type '...'? name)*)? ')' ('implements' types)? body
annodecl <~ '@' 'interface' name '{' member* '}'
types <~ type (',' type)*
body <- '{' member* '}'
member <- ';' / 'static'? block / typedecl / modifiers tparams? (name '(' params ')' throws? block / name block / ('void' / type) name '(' params ')' dims throws? (block / ('default' elemvalue)? ';') / type declarators ';')
params <~ (param (',' param)*)?
param <~ modifiers type annotation* '...'? ('this' / name ('.' 'this')?) dims
throws <~ 'throws' types
dims <~ (annotation* '[' ']')*
declarators <~ declarator (',' declarator)*
declarator <~ name dims ('=' (arrayinit / expr))?
arrayinit <- '{' ((arrayinit / expr) (',' (arrayinit / expr))*)? ','? '}'
type <- annotation* (prim / name targs? ('.' annotation* name targs?)*) dims
prim <~ 'boolean' / 'byte' / 'short' / 'int' / 'long' / 'char' / 'float' / 'double'
targs <- '<' (targ (',' targ)*)? '>'
targ <~ annotation* '?' (('extends' / 'super') type)? / type
tparams <- '<' annotation* name ('extends' type ('&' type)*)? (',' annotation* name ('extends' type ('&' type)*)?)* '>'
block <- '{' stmt* '}'
stmt <- block / ';' / 'if' '(' expr ')' stmt ('else' stmt)? / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / 'for' '(' forhead ')' stmt
  / 'return' expr? ';' / 'break' name? ';' / 'continue' name? ';' / 'throw' expr ';' / trying / switch / 'synchronized' '(' expr ')' block / 'assert' expr (':' expr)? ';'
  / 'yield' !('=' / '.' / '(' / '++' / '--') expr ';' / local ';' / localtype / name ':' stmt / expr ';'
localtype <~ modifiers (classdecl / interfacedecl / enumdecl / recorddecl)
local <- modifiers type declarators
forhead <~ modifiers type name ':' expr / (local / expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?
trying <~ 'try' ('(' resource (';' resource)* ';'? ')' block ('catch' '(' catchparam ')' block)* ('finally' block)? / block (('catch' '(' catchparam ')' block)+ ('finally' block)? / 'finally' block))
resource <~ modifiers type name '=' expr / expr
catchparam <~ modifiers type ('|' type)* name
switch <- 'switch' '(' expr ')' '{' (label ('->' (block / 'throw' expr ';' / expr ';') / ':' stmt*))* '}'
label <~ 'case' caseitem (',' caseitem)* ('when' expr)? / 'default'
caseitem <~ 'null' / 'default' / pattern &('->' / ':' / ',' / 'when') / cond
pattern <- modifiers type ('(' (pattern (',' pattern)*)? ')' name? / name)
expr <- lambda / cond (assignop expr)?
lambda <~ (name / '(' (name (',' name)* / params) ')') '->' (block / expr)
assignop <~ '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>='
cond <- binary ('?' expr ':' (lambda / cond))?
binary <- unary (binop unary / 'instanceof' ('final'? pattern / type))*
binop <~ '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '>=' / '<' '<'? / '>' ('>' '>'?)? / '&&' / '||' / '&' / '|' / '^'
unary <- ('+' / '-' / '++' / '--' / '!' / '~') unary / cast / postfix
cast <~ '(' prim dims ')' unary / '(' type ('&' type)* ')' (lambda / &caststart unary)
caststart <~ ID / 'var' / 'record' / 'NUM' / NUM / STR / CHR / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch' / 'int' / 'long' / 'char' / 'byte' / 'short' / 'float' / 'double' / 'boolean' / 'yield' / 'when' / 'open' / 'module'
postfix <- primary trailer* ('++' / '--')*
trailer <~ '.' ('new' targs? creator / targs? (name / 'super' / 'this') ('(' args ')')? / 'class') / '[' expr ']' / '::' targs? (name / 'new')
primary <~ NUM / STR / CHR / 'true' / 'false' / 'null' / ('this' / 'super') ('(' args ')')? / '(' expr ')' / 'new' targs? creator / switch / (prim / 'void') dims ('.' 'class' / '::' 'new') / methodref / name ('(' args ')')?
methodref <~ name targs ('.' name targs?)* dims '::' (name / 'new') / name ('.' name)* (annotation* '[' ']')+ ('.' 'class' / '::' 'new')
creator <~ annotation* (prim / name targs? ('.' annotation* name targs?)*) ((annotation* '[' ']')+ arrayinit / (annotation* '[' expr ']')+ dims / '(' args ')' body?)
args <~ (expr (',' expr)*)?
"""

# Rules with an X come twice: without composite literals (X becomes N) in the heads of statements, and with them.
_GO_EXPRESSIONS = """
exprX <- unaryX (binop unaryX)*
unaryX <~ ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* primaryX
primaryX <- operandX trailerX*
"""
GO = """
file <- 'package' ID ';' (importing ';')* (top ';')* EOF
importing <~ 'import' (importspec / '(' (importspec ';')* importspec? ')')
importspec <~ ('.' / ID)? STR
top <~ func / decl
decl <~ 'const' (constspec / '(' (constspec ';')* constspec? ')') / 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
constspec <~ ids (type? '=' exprs)?
varspec <~ ids (type ('=' exprs)? / '=' exprs)
typespec <~ ID (tparams type / '='? type)
tparams <~ '[' tparam (',' tparam)* ','? ']'
tparam <~ ids constraint
constraint <~ '~'? type ('|' '~'? type)*
ids <~ ID (',' ID)*
exprs <~ expr (',' expr)*
func <- 'func' params? ID tparams? signature block?
signature <~ params (params / type)?
params <- '(' (param (',' param)*)? ','? ')'
param <~ ids '...'? type / '...'? type
type <- ID ('.' ID)? ('[' type (',' type)* ','? ']')? / '*' type / '(' type ')' / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / '<-' 'chan' type / 'chan' '<-'? type / 'func' signature / structtype / interfacetype
structtype <- 'struct' '{' (field ';')* field? '}'
field <~ (ids type / '*'? ID ('.' ID)? ('[' type (',' type)* ']')?) STR?
interfacetype <- 'interface' '{' (imember ';')* imember? '}'
imember <~ ID signature / constraint
block <- '{' stmts '}'
stmts <~ (stmt? ';')* stmt?
stmt <- decl / block / 'return' exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / 'defer' expr / 'go' expr / ifs / switch / select / for / ID ':' !'=' stmt? / simple
simple <~ exprs (':=' exprs / assignop exprs / '++' / '--' / '<-' expr)?
simpleN <~ exprsN (':=' exprsN / assignop exprsN / '++' / '--' / '<-' exprN)?
exprsN <~ exprN (',' exprN)*
assignop <~ '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
ifs <- 'if' (simpleN? ';')? exprN block ('else' (ifs / block))?
switch <- 'switch' (typeguard &'{' / (simpleN? ';')? exprN? &'{') '{' ((('case' (expr / type) (',' (expr / type))*) / 'default') ':' stmts)* '}'
typeguard <~ (simpleN? ';')? (ID ':=')? primaryN
select <~ 'select' '{' ((('case' simple) / 'default') ':' stmts)* '}'
for <- 'for' ((exprsN (':=' / '='))? 'range' exprN / simpleN? ';' exprN? ';' simpleN? / exprN?) block
binop <~ '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&^' / '&'
{full}
{bare}
operand <~ NUM / STR / CHR / 'func' signature block / littype litvalue / '(' (expr / type) ')' / ID litvalue? / type
operandN <~ NUM / STR / CHR / 'func' signature block / ('[' ('...' / expr)? ']' type / 'map' '[' type ']' type / structtype) litvalue / '(' (expr / type) ')' / ID / type
littype <~ ID ('.' ID)? '[' type (',' type)* ']' / ID '.' ID / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / structtype
litvalue <- '{' (element (',' element)*)? ','? '}'
element <~ (expr / litvalue) (':' (expr / litvalue))?
trailer <~ '.' (ID / '(' (type / 'type') ')') / '[' index ']' / '(' callargs ')' / litvalue_after
litvalue_after <~ &'{' !'{'  '}'
trailerN <~ '.' (ID / '(' (type / 'type') ')') / '[' index ']' / '(' callargs ')'
index <~ expr? ':' expr? (':' expr)? / (expr / type) (',' type)* ','?
callargs <~ ((expr / type) (',' (expr / type))* '...'? ','?)?
"""
GO = GO.replace("{full}", _GO_EXPRESSIONS.replace("X", "")).replace("{bare}", _GO_EXPRESSIONS.replace("X", "N")).replace(" / litvalue_after", "").replace("litvalue_after <~ &'{' !'{'  '}'\n", "")

_RUST_EXPRESSIONS = """
exprX <- 'return' exprX? / 'break' LIFE? exprX? / 'continue' LIFE? / closureX / rangeX (assignop exprX)?
closureX <~ 'static'? 'async'? 'move'? ('||' / '|' (clparam (',' clparam)* ','?)? '|') ('->' type block / exprX)
rangeX <~ ('..' / '..=') binaryX? / binaryX (('..' / '..=') binaryX?)?
binaryX <- unaryX (binop unaryX / 'as' type)*
unaryX <~ ('-' / '!' / '*' / ('&' / '&&') 'mut'?)* (postfixX / closureX)
postfixX <- primaryX trailer*
primaryX <~ NUM / STR / CHR / 'true' / 'false' / '(' (expr (',' expr)* ','?)? ')' / '[' (attr* expr (';' expr / (',' attr* expr)* ','?))? ']' / blocklike / macrocall / 'let' pat '=' binaryN / '_' / pathX
"""
RUST = """
file <- innerattr* item* EOF
innerattr <~ '#' '!' '[' tt* ']'
attr <~ '#' '[' tt* ']'
tt <- '(' tt* ')' / '[' tt* ']' / '{' tt* '}' / ttoken
item <- attr* vis? (func / struct / enum / union / implb / trait / mod / use / const / static / typealias / extern / macroitem)
macroitem <~ ID '!' ID ('{' tt* '}' / '(' tt* ')' ';') / spath '!' ('{' tt* '}' !('.' / '?') / '(' tt* ')' ';' / '[' tt* ']' ';')
vis <~ 'pub' ('(' ('crate' / 'self' / 'super' / 'in' spath) ')')?
spath <~ '::'? pathword ('::' pathword)*
pathword <~ ID / 'self' / 'super' / 'crate' / 'Self'
func <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' ID generics? '(' (fparam (',' fparam)* ','?)? ')' ('->' type)? where? (block / ';')
fparam <~ attr* (selfparam / '...' / pat ':' ('...' / type) / type)
selfparam <~ ('&' LIFE?)? 'mut'? 'self' (':' type)?
generics <- '<' (gparam (',' gparam)* ','?)? '>'
gparam <~ attr* (LIFE (':' LIFE? ('+' LIFE)*)? / 'const' ID ':' type ('=' (block / '-'? NUM / ID))? / ID (':' bounds?)? ('=' type)?)
where <~ 'where' (wherep (',' wherep)*)? ','?
wherep <~ LIFE ':' (LIFE ('+' LIFE)*)? / forall? type ':' bounds?
forall <~ 'for' generics
bounds <- bound ('+' bound)* '+'?
bound <~ LIFE / '?'? forall? path / '(' '?'? forall? path ')' / '~' 'const' path
struct <~ 'struct' ID generics? (where? '{' (sfield (',' sfield)* ','?)? '}' / '(' (tfield (',' tfield)* ','?)? ')' where? ';' / where? ';')
union <~ ID ID generics? where? '{' (sfield (',' sfield)* ','?)? '}'
sfield <~ attr* vis? ID ':' type
tfield <~ attr* vis? type
enum <~ 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}'
variant <~ attr* vis? ID ('{' (sfield (',' sfield)* ','?)? '}' / '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)?
implb <~ 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' innerattr* item* '}'
trait <~ 'unsafe'? 'trait' ID generics? (':' bounds?)? where? ('{' innerattr* item* '}' / '=' bounds where? ';')
mod <~ 'unsafe'? 'mod' ID (';' / '{' innerattr* item* '}')
use <~ 'use' usetree ';'
usetree <- '::'? ('*' / '{' (usetree (',' usetree)* ','?)? '}' / pathword (('::' pathword)* ('::' ('*' / '{' (usetree (',' usetree)* ','?)? '}') / 'as' (ID / '_'))?))
const <~ 'const' (ID / '_') ':' type ('=' expr)? ';'
static <~ 'static' 'mut'? ID ':' type ('=' expr)? ';'
typealias <~ 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';'
extern <~ 'extern' 'crate' (ID / 'self') ('as' (ID / '_'))? ';' / 'unsafe'? 'extern' STR? '{' innerattr* item* '}'
type <- '(' (type (',' type)* ','?)? ')' / '!' / '_' / ('&' / '&&') LIFE? 'mut'? type / '*' ('const' / 'mut') type / '[' type (';' expr)? ']' / ('impl' / 'dyn') bounds / forall? ('unsafe' / 'extern' STR?)* 'fn' '(' (fntparam (',' fntparam)* ','?)? ')' ('->' type)? / forall path / macrotype / path
macrotype <~ spath '!' ('(' tt* ')' / '[' tt* ']' / '{' tt* '}')
fntparam <~ '...' / ((ID / '_') ':' !':')? type
path <- ('<' type ('as' path)? '>' '::' / '::')? pathseg ('::' pathseg)*
pathseg <~ pathword ('::'? gargs / '(' (type (',' type)* ','?)? ')' ('->' type)?)?
gargs <- '<' (garg (',' garg)* ','?)? '>'
garg <~ LIFE / ID gargs? '=' type / ID ':' bounds / type / block / '-'? NUM / STR / CHR / 'true' / 'false'
block <- '{' innerattr* stmt* (attr* expr)? '}'
stmt <- ';' / attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' / item / attr* exprstmt
exprstmt <~ blocklike !('.' / '?') / macrostmt / expr ';'
macrostmt <~ spath '!' '{' tt* '}' !('.' / '?')
blocklike <- (LIFE ':')? (block / 'loop' block / 'while' exprN block / 'for' pat 'in' exprN block) / ifs / match / 'unsafe' block / 'async' 'move'? block / 'const' block
ifs <~ 'if' exprN block ('else' (ifs / block))?
match <~ 'match' exprN '{' innerattr* (arm)* '}'
arm <~ attr* pat ('if' expr)? '=>' (blocklike !('.' / '?') ','? / expr (',' / &'}'))
clparam <~ attr* patone (':' type)?
pat <- '|'? patone ('|' patone)*
patone <- '_' / '..' patlit? / ('&' / '&&') 'mut'? patone / '(' (pat (',' pat)* ','?)? ')' / '[' (pat (',' pat)* ','?)? ']' / patconst (('..=' / '...' / '..') patlit?)? / '..=' patlit / 'ref'? 'mut'? ID !('::' / '(' / '{' / '!') ('@' patone)? / macrocall / path ('(' (pat (',' pat)* ','?)? ')' / '{' (patfield (',' patfield)* ','?)? '}' / (('..=' / '...' / '..') patlit?)?)
patconst <~ '-'? NUM / STR / CHR / 'true' / 'false'
patlit <~ patconst / path
patfield <~ attr* ('..' / (ID / NUM) ':' pat / 'ref'? 'mut'? ID)
assignop <~ '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '<' '<=' / '>' '>='
binop <~ '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' '<'? / '>' '>'? / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&'
{full}
{bare}
path_ <~ ('<' type ('as' path)? '>' '::' / '::')? eseg ('::' (eseg / gargs))*
eseg <~ pathword
pathx <- path_
pathN <~ path_
pathX_ <~ path_ ('{' (efield (',' efield)* ','?)? ('..' expr?)? '}')?
efield <~ attr* ((ID / NUM) (':' expr)?)
macrocall <~ spath '!' ('(' tt* ')' / '[' tt* ']' / '{' tt* '}')
trailer <~ '?' / '.' ('await' / NUM / ID ('::' gargs)? ('(' args ')')?) / '(' args ')' / '[' expr ']'
args <~ (attr* expr (',' attr* expr)*)? ','?
"""
_RUST_TOKENS = " / ".join(f"'{t}'" for t in sorted((lexers.RUST_WORDS | frozenset("; , . .. ... ..= :: : -> => = == != ! + += - -= * *= / /= % %= & && &= | || |= ^ ^= < <= <<= > >= >>= ? @ # $ ~ _".split()))))
RUST = RUST.replace("{full}", _RUST_EXPRESSIONS.replace("X", "").replace("/ path\n", "/ structlit\n")).replace("{bare}", _RUST_EXPRESSIONS.replace("('..' / '..=') binaryX?", "('..' / '..=') (!'{' binaryX)?").replace("X", "N"))
RUST = RUST.replace("pathX_ <~", "structlit <~").replace("pathx <- path_\n", "") + f"ttoken <~ ID / NUM / STR / CHR / LIFE / {_RUST_TOKENS}\n"

TEXTS = {"json": JSON, "toml": TOML, "python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "java": JAVA, "go": GO, "rust": RUST}


@cache
def grammar(language: str) -> Grammar:
    return Grammar(TEXTS[language])
