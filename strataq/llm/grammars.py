"""Grammars of six programming languages for the parser with derivatives, without left recursion.

Precedence does not matter for whether a text is valid, so operators form flat chains. Words that are reserved
only in places (``get``, ``type``, ``var``) are names elsewhere.
"""

from __future__ import annotations

from functools import cache

from strataq.llm.derivatives import Grammar

PYTHON = r"""
file: stmt* ;
stmt: simple | compound ;
simple: small (';' small)* ';'? NEWLINE ;
small: 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' ID (',' ID)* | 'nonlocal' ID (',' ID)*
    | 'del' exprs | 'assert' expr (',' expr)? | 'import' dotted_as (',' dotted_as)* | 'from' ('.' | '...')* dotted? 'import' names
    | expr_stmt | yield | ID ID typeparams? '=' expr ;
dotted: ID ('.' ID)* ;
dotted_as: dotted ('as' ID)? ;
names: '*' | name_as (',' name_as)* | '(' name_as (',' name_as)* ','? ')' ;
name_as: ID ('as' ID)? ;
expr_stmt: exprs (':' expr ('=' rhs)? | augment rhs | ('=' rhs)*) ;
augment: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' | '@=' ;
rhs: exprs | yield ;
yield: 'yield' ('from' expr | exprs)? ;
exprs: star_expr (',' star_expr)* ','? ;
star_expr: '*'? named ;
named: expr (':=' expr)? ;
expr: lambda | or_test ('if' or_test 'else' expr)? ;
lambda: 'lambda' lparams ':' expr ;
lparams: (lparam (',' lparam)* ','?)? ;
lparam: ID ('=' expr)? | '*' ID? | '**' ID | '/' ;
or_test: not_test (('and' | 'or') not_test)* ;
not_test: 'not'* comparison ;
comparison: arith (compare arith)* ;
compare: '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ;
arith: factor (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**') factor)* ;
factor: ('+' | '-' | '~')* 'await'? power ;
power: atom trailer* ;
trailer: '(' args ')' | '[' subscripts ']' | '.' ID ;
args: (arg (',' arg)* ','?)? ;
arg: named comp? | ID '=' expr | '*' expr | '**' expr ;
subscripts: subscript (',' subscript)* ','? ;
subscript: '*'? named | expr? ':' expr? (':' expr?)? ;
atom: '(' (yield | star_expr comp | exprs)? ')' | '[' (star_expr comp | exprs)? ']' | '{' dict_or_set? '}' | ID | NUM | string+ | '...' | 'None' | 'True' | 'False' ;
string: STR | SB hole* SE ;
hole: '${' (exprs | yield) '='? '}$' ;
dict_or_set: entry (comp | (',' entry)* ','?) | star_expr (comp | (',' star_expr)* ','?) ;
entry: expr ':' expr | '**' expr ;
comp: 'async'? 'for' targets 'in' or_test ('if' named)* comp? ;
targets: target (',' target)* ','? ;
target: '*'? power | '(' targets ')' ;
compound: 'if' named ':' suite ('elif' named ':' suite)* else? | 'while' named ':' suite else? | 'async'? 'for' targets 'in' exprs ':' suite else?
    | 'try' ':' suite (handler+ else? finally? | finally) | 'async'? 'with' with_items ':' suite | decorator* ('async'? def | class) | match ;
else: 'else' ':' suite ;
finally: 'finally' ':' suite ;
handler: 'except' '*'? (exprs ('as' ID)?)? ':' suite ;
with_items: with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')' ;
with_item: expr ('as' target)? ;
decorator: '@' named NEWLINE ;
def: 'def' ID typeparams? '(' params ')' ('->' expr)? ':' suite ;
typeparams: '[' ('*' | '**')? ID (':' expr)? (',' ('*' | '**')? ID (':' expr)?)* ','? ']' ;
params: (param (',' param)* ','?)? ;
param: ID (':' expr)? ('=' expr)? | '*' (ID (':' star_expr)?)? | '**' ID (':' expr)? | '/' ;
class: 'class' ID typeparams? ('(' args ')')? ':' suite ;
suite: simple | NEWLINE INDENT stmt+ DEDENT ;
match: ID exprs ':' NEWLINE INDENT case+ DEDENT ;
case: ID pattern ('if' named)? ':' suite ;
pattern: exprs ('as' ID)? ;
"""

_SCRIPT = r"""
file: item* ;
item: import | export | decl ;
import: 'import' (STR | (default (',' (star | braces))? | star | braces) 'from' STR) with? ';' | 'import' typeword (default | star | braces) 'from' STR ';' ;
with: 'with' object ;
default: name ;
star: '*' asword name ;
braces: '{' (spec (',' spec)* ','?)? '}' ;
spec: typeword? (anyname | STR) (asword (anyname | STR))? ;
asword: 'as' | ID ;
typeword: 'type' | ID ;
export: 'export' (decl | 'default' (function | class | assign ';') | typeword? star_from | typeword? braces ('from' STR)? ';' | '=' expr ';') ;
star_from: '*' (asword anyname)? 'from' STR ';' ;
decl: function | class | stmt | ts ;
stmt: block | var ';' | ';' | opening ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' 'await'? '(' for ')' stmt | 'while' '(' expr ')' stmt
    | 'do' stmt 'while' '(' expr ')' ';'? | 'continue' name? ';' | 'break' name? ';' | 'return' expr? ';' | 'with' '(' expr ')' stmt
    | 'switch' '(' expr ')' '{' case* '}' | name ':' stmt | 'throw' expr ';' | 'try' block (catch finally? | finally) | 'debugger' ';' ;
block: '{' decl* '}' ;
catch: 'catch' ('(' binding annot? ')')? block ;
finally: 'finally' block ;
case: ('case' expr | 'default') ':' decl* ;
var: ('var' | 'let' | 'const') declarator (',' declarator)* ;
declarator: binding '!'? annot? ('=' assign)? ;
for: (var | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') binding annot? | unary) ('of' assign | 'in' expr) ;
binding: name | '[' (bindel? (',' bindel?)*) ']' | '{' (prop (',' prop)* ','?)? '}' ;
bindel: '...'? binding ('=' assign)? ;
prop: '...' binding | propname ':' binding ('=' assign)? | name ('=' assign)? ;
function: 'async'? 'function' '*'? name? signature (block | ';') ;
signature: typeparams? '(' params ')' annot? ;
params: (param (',' param)* ','?)? ;
param: decorator* modifier* ('...'? binding '?'? annot? ('=' assign)? | 'this' annot) ;
class: decorator* 'class' name? typeparams? heritage '{' member* '}' ;
heritage: ('extends' unary)? ;
member: ';' | 'static' block | decorator* modifier* (('get' | 'set')? propname signature (block | ';') | 'async'? '*'? propname '?'? signature (block | ';') | propname ('?' | '!')? annot? ('=' assign)? ';') ;
modifier: 'static' ;
propname: anyname | STR | NUM | '[' assign ']' | '#' anyname ;
anyname: name | KEYWORD ;
decorator: '@' unary ;
expr: assign (',' assign)* ;
# an expression that is a statement does not begin with a brace, a function or a class
opening: opening_assign (',' assign)* ;
opening_assign: 'yield' ('*'? assign)? | arrow | opening_binary ('?' assign ':' assign)? (assignop assign)? ;
opening_binary: opening_unary (binop unary | castop)* ;
opening_unary: prefix_op+ postfix | 'new'+ primary suffix* ('++' | '--')? | plain suffix* ('++' | '--')? ;
prefix_op: '+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' ;
assign: 'yield' ('*'? assign)? | arrow | conditional (assignop assign)? ;
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '**=' | '&&=' | '||=' | '??=' ;
arrow: 'async'? (name | signature) '=>' (block | assign) ;
conditional: binary ('?' assign ':' assign)? ;
binary: unary (binop unary | castop)* ;
binop: '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' '>'? | 'in' | 'instanceof' ;
unary: ('+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--')* postfix ;
postfix: 'new'* primary suffix* ('++' | '--')? ;
suffix: '.' '#'? anyname | '?.' (anyname | '(' args ')' | '[' expr ']') | '[' expr ']' | typeargs? '(' args ')' | template | nonnull ;
args: (arg (',' arg)* ','?)? ;
arg: '...'? assign ;
primary: plain | object | function | class ;
plain: name | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | template | '[' (element? (',' element?)*) ']' | '(' expr ')'
    | 'import' ('(' args ')' | '.' name) | 'new' '.' name ;
template: SB hole* SE ;
hole: '${' expr '}$' ;
element: '...'? assign ;
object: '{' (field (',' field)* ','?)? '}' ;
field: '...' assign | propname ':' assign | name ('=' assign)? | ('get' | 'set')? propname signature block | 'async'? '*'? propname signature block ;
name: ID | 'async' | 'of' | 'static' | 'get' | 'set' | 'from' ;
"""

JAVASCRIPT = _SCRIPT + r"""
ts: NEVER ;
annot: NEVER ;
typeparams: NEVER ;
typeargs: NEVER ;
castop: NEVER ;
nonnull: NEVER ;
"""

TYPESCRIPT = (
    _SCRIPT.replace("name: ID |", "name: ID | 'type' | 'as' | 'declare' | 'namespace' | 'abstract' | 'is' | 'keyof' | 'readonly' | 'infer' | 'satisfies' |")
    .replace("modifier: 'static' ;", "modifier: 'static' | 'private' | 'public' | 'protected' | 'readonly' | 'abstract' | 'declare' ;")
    .replace("heritage: ('extends' unary)? ;", "heritage: ('extends' unary typeargs? (',' unary)*)? ('implements' type (',' type)*)? ;")
    .replace("class: decorator* 'class'", "class: decorator* 'abstract'? 'class'")
    .replace("member: ';' |", "member: ';' | modifier* '[' name ':' type ']' annot? ';' |")
) + r"""
ts: 'declare' decl | 'interface' name typeparams? ('extends' type (',' type)*)? objtype | 'type' name typeparams? '=' type ';' | 'const'? 'enum' name '{' (enumel (',' enumel)* ','?)? '}'
    | 'namespace' name ('.' name)* '{' item* '}' ;
enumel: propname ('=' assign)? ;
annot: ':' (type | ID 'is' type | 'this' 'is' type | 'asserts' type) ;
typeparams: '<' typeparam (',' typeparam)* ','? '>' ;
typeparam: 'const'? name ('extends' type)? ('=' type)? ;
typeargs: '<' type (',' type)* '>' ;
type: (signature_type '=>' type) | union ('extends' union '?' type ':' type)? ;
signature_type: 'new'? typeparams? '(' params ')' ;
union: ('|' | '&')? prefix (('|' | '&') prefix)* ;
prefix: ('keyof' | 'readonly' | 'infer')* array ;
array: basic ('[' type? ']')* ;
basic: 'typeof' name ('.' anyname)* | name ('.' anyname)* typeargs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | objtype | '[' (tuple (',' tuple)* ','?)? ']' | '(' type ')' | template_type | 'import' '(' STR ')' ('.' name)* typeargs? ;
tuple: '...'? (name '?'? ':')? type '?'? ;
template_type: SB ('${' type '}$')* SE ;
objtype: '{' (tmember ((';' | ',') tmember)* (';' | ',')?)? '}' ;
tmember: 'readonly'? (propname '?'? (annot | signature)? | '[' name (':' | 'in') type (asword type)? ']' '?'? annot?) | 'new'? signature | ('get' | 'set') propname signature ;
castop: ('as' | 'satisfies') ('const' | type) ;
nonnull: '!' ;
"""

GO = r"""
file: 'package' ID ';' (import ';')* (top ';')* ;
import: 'import' (spec | '(' (spec (';' spec)* ';'?)? ')') ;
spec: (ID | '.')? STR ;
top: func | decl ;
decl: 'var' (varspec | '(' (varspec (';' varspec)* ';'?)? ')') | 'const' (constspec | '(' (constspec (';' constspec)* ';'?)? ')') | 'type' (typespec | '(' (typespec (';' typespec)* ';'?)? ')') ;
varspec: ids (type ('=' exprs)? | '=' exprs) ;
constspec: ids (type? '=' exprs)? ;
typespec: ID typeparams? '='? type ;
ids: ID (',' ID)* ;
typeparams: '[' ids constraint (',' ids constraint)* ','? ']' ;
constraint: '~'? type ('|' '~'? type)* ;
func: 'func' ('(' params ')')? ID typeparams? signature block? ;
signature: '(' params ')' result? ;
result: type | '(' params ')' ;
params: (param (',' param)* ','?)? ;
param: ID? '...'? type ;
type: ID ('.' ID)? ('[' type (',' type)* ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature
    | 'struct' '{' (field (';' field)* ';'?)? '}' | 'interface' '{' (element (';' element)* ';'?)? '}' | '(' type ')' ;
field: (ids type | '*'? ID ('.' ID)?) STR? ;
element: ID signature | constraint ;
block: '{' stmts '}' ;
stmts: (stmt? ';')* stmt? ;
stmt: decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for | 'go' expr | 'defer' expr | ID ':' stmt? ;
simple: exprs ('++' | '--' | (':=' | '=' | assignop) exprs | '<-' expr)? ;
assignop: '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
if: 'if' (simple? ';')? hexpr block ('else' (if | block))? ;
hsimple: hexprs ('++' | '--' | (':=' | '=' | assignop) hexprs)? ;
switch: 'switch' (hsimple? ';')? hsimple? '{' (('case' cases | 'default') ':' stmts)* '}' ;
cases: (expr | type) (',' (expr | type))* ;
select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
for: 'for' (hexpr | (hsimple? ';' hexpr? ';' hsimple?) | (hexprs (':=' | '='))? 'range' hexpr)? block ;
exprs: expr (',' expr)* ;
hexprs: hexpr (',' hexpr)* ;
expr: unary (binop unary)* ;
hexpr: hunary (binop hunary)* ;
binop: '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* operand suffix* ;
hunary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* hoperand hsuffix* ;
operand: hoperand | ID literal ;
hoperand: ID | NUM | STR | CHAR | '(' (expr | type) ')' | 'func' signature block | comptype literal? ;
comptype: '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field (';' field)* ';'?)? '}' | 'chan' type | 'interface' '{' '}' ;
suffix: hsuffix | literal ;
hsuffix: '.' (ID | '(' (type | 'type') ')') | '[' (expr (',' type)* | expr? ':' expr? (':' expr)?) ']' | '(' (arg (',' arg)* '...'? ','?)? ')' ;
arg: expr | type ;
literal: '{' (elem (',' elem)* ','?)? '}' ;
elem: (expr | literal) (':' (expr | literal))? ;
"""

CSHARP = r"""
file: using* attr_global* (namespace_line)? item* ;
using: 'using' 'static'? (ID '=')? type ';' ;
attr_global: '[' ID ':' args0 ']' ;
namespace_line: 'namespace' qname ';' using* ;
item: namespace | typedecl | stmt ;
namespace: 'namespace' qname '{' using* (namespace | typedecl)* '}' ;
qname: ID ('.' ID)* ;
attrs: ('[' (ID ':')? attr (',' attr)* ','? ']')* ;
attr: qname typeargs? ('(' args ')')? ;
modifier: 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'const' | 'ref' | ID ;
typedecl: attrs modifier* (('class' | 'struct' | 'interface' | ID ('class' | 'struct')?) ID typeparams? ('(' params ')')? bases? where* ('{' member* '}' ';'? | ';') | 'enum' ID (':' type)? '{' (enumel (',' enumel)* ','?)? '}' ';'? | 'delegate' type ID typeparams? '(' params ')' where* ';') ;
bases: ':' base (',' base)* ;
base: type ('(' args ')')? ;
where: ID ID ':' constraint (',' constraint)* ;
constraint: type | 'class' | 'struct' | 'new' '(' ')' ;
enumel: attrs ID ('=' expr)? ;
typeparams: '<' attrs ('in' | 'out')? ID (',' attrs ('in' | 'out')? ID)* '>' ;
member: typedecl | attrs modifier* (type declarator (',' declarator)* ';' | 'event' type declarator ';' | type mname typeparams? '(' params ')' where* body | ID '(' params ')' (':' ('base' | 'this') '(' args ')')? body | '~' ID '(' ')' body
    | type mname (accessors ('=' expr ';')? | '=>' expr ';') | type 'this' '[' params ']' (accessors | '=>' expr ';') | type 'operator' operator '(' params ')' body | ('implicit' | 'explicit') 'operator' type '(' params ')' body) ;
operator: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '!' | '~' | '&' | '|' | '^' | '<<' | '>' '>' | '++' | '--' | 'true' | 'false' ;
mname: ID typeargs? ('.' ID typeargs?)* ;
accessors: '{' (attrs modifier? ID (';' | block | '=>' expr ';'))+ '}' ;
body: block | '=>' expr ';' | ';' ;
params: (param (',' param)*)? ;
param: attrs ('ref' | 'out' | 'in' | 'params' | 'this' | 'readonly')* type ID ('=' expr)? ;
type: basetype ('?' | '*' | '[' ','* ']')* ;
basetype: ID ('::' ID)? typeargs? ('.' ID typeargs?)* | predefined | '(' type ID? (',' type ID?)+ ')' | 'ref' type ;
predefined: 'bool' | 'byte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'long' | 'object' | 'sbyte' | 'short' | 'string' | 'uint' | 'ulong' | 'ushort' | 'void' ;
typeargs: '<' (type (',' type)* | ','*) '>' ;
block: '{' stmt* '}' ;
stmt: block | ';' | local ';' | expr ';' | 'const' local ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
    | 'for' '(' (local | exprs)? ';' expr? ';' exprs? ')' stmt | 'foreach' '(' type (ID | tuple_names) 'in' expr ')' stmt | ID 'foreach' '(' type ID 'in' expr ')' stmt | 'switch' '(' expr ')' '{' section* '}' | 'break' ';' | 'continue' ';'
    | 'return' expr? ';' | 'throw' expr? ';' | 'goto' (ID | 'case' expr | 'default') ';' | 'try' block (catch+ finally? | finally) | 'using' ('(' (local | expr) ')' stmt | local ';') | ID 'using' local ';' | 'lock' '(' expr ')' stmt
    | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' local ')' stmt | ID ':' stmt | ID ('return' expr | 'break') ';' | attrs modifier* type ID typeparams? '(' params ')' where* body ;
tuple_names: '(' ID (',' ID)* ')' ;
local: ('ref' 'readonly'?)? type declarator (',' declarator)* ;
declarator: ID ('=' ('ref'? expr | initializer))? ;
section: (('case' pattern (ID expr)? | 'default') ':')+ stmt+ ;
catch: 'catch' ('(' type ID? ')')? (ID '(' expr ')')? block ;
finally: 'finally' block ;
exprs: expr (',' expr)* ;
expr: lambda | 'throw' expr | cond (assignop expr)? ;
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '??=' ;
lambda: modifier? (ID | type? '(' (lparam (',' lparam)*)? ')') '=>' (block | expr) ;
lparam: ('ref' | 'out' | 'in')? (type? ID) ('=' expr)? ;
cond: binary ('?' expr ':' expr)? ;
binary: unary (binop unary | 'is' pattern | 'as' type | 'switch' '{' (arm (',' arm)* ','?)? '}' | '..' unary?)* ;
binop: '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%' ;
arm: pattern (ID expr)? '=>' expr ;
pattern: pattern1 (ID pattern1)* ;
pattern1: ID? (type (ID | tuple_names)? | binary_const | '{' (ID ('.' ID)* ':' pattern (',' ID ':' pattern)* ','?)? '}' ID? | type '{' (ID ':' pattern (',' ID ':' pattern)*)? '}' ID? | ('<' | '>' | '<=' | '>=') unary | '(' pattern (',' pattern)* ')' | '[' (pattern (',' pattern)*)? ']') ;
binary_const: unary (('|' | '+' | '-') unary)* ;
unary: ('+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | '(' type ')')* postfix ;
postfix: ID? primary suffix* ;
suffix: '.' ID typeargs? | '?.' ID typeargs? | '?' '[' args ']' | '[' args ']' | '(' args ')' | '++' | '--' | '!' | '->' ID ;
args0: ID ('(' args ')')? ;
args: (arg (',' arg)* ','?)? ;
arg: (ID ':')? ('ref' | 'in')? (expr ('=' expr)?) | (ID ':')? 'out' (expr | type ID) ;
primary: ID typeargs? | ID '::' ID | NUM | STR | CHAR | interpolated | 'null' | 'true' | 'false' | 'this' | 'base' | predefined | '(' (ID ':')? expr (',' (ID ':')? expr)* ')' | new | 'typeof' '(' type ')' | 'sizeof' '(' type ')' | 'default' ('(' type ')')?
    | 'checked' '(' expr ')' | 'unchecked' '(' expr ')' | 'delegate' ('(' params ')')? block | '[' (('..')? expr (',' ('..')? expr)* ','?)? ']' | 'stackalloc' type initializer? ;
new: 'new' (type? '[' exprs? ']' ('[' ']')* initializer? | type ('(' args ')')? objinit? | '(' args ')' objinit? | anon | '[' ']' initializer) ;
anon: '{' (anonel (',' anonel)* ','?)? '}' ;
anonel: (ID '=')? expr ;
objinit: '{' (init (',' init)* ','?)? '}' ;
init: (ID | '[' args ']') '=' (expr | objinit) | expr | objinit ;
initializer: '{' ((expr | initializer) (',' (expr | initializer))* ','?)? '}' ;
interpolated: SB ('${' expr (',' expr)? '}$')* SE ;
"""

RUST = r"""
file: inner* item* ;
inner: '#' '!' tree ;
attr: '#' tree ;
tree: '(' tts ')' | '[' tts ']' | '{' tts '}' ;
tts: (tt)* ;
tt: tree | ANY ;
vis: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')? ;
item: attr* vis? (fn | struct | enum | impl | trait | use | mod | const | static | typealias | extern) | attr* macro_item ;
macro_item: path '!' ID? (('(' tts ')' | '[' tts ']') ';' | '{' tts '}') ;
use: 'use' usetree ';' ;
usetree: '::'? (useseg '::')* (useseg ('as' (ID))? | '*' | '{' (usetree (',' usetree)* ','?)? '}') ;
useseg: ID | 'self' | 'super' | 'crate' | 'Self' ;
mod: 'unsafe'? 'mod' ID (';' | '{' inner* item* '}') ;
extern: 'extern' ('crate' (ID | 'self') ('as' ID)? ';' | STR? '{' item* '}') ;
const: 'const' ID ':' type ('=' expr)? ';' ;
static: 'static' 'mut'? ID ':' type ('=' expr)? ';' ;
typealias: 'type' ID generics? (':' bounds)? where? ('=' type)? ';' ;
fn: ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID generics? '(' (fnparam (',' fnparam)* ','?)? ')' ('->' type)? where? (block | ';') ;
fnparam: attr* ('&' LIFE? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pattern ':' type) ;
generics: '<' (generic (',' generic)* ','?)? '>' ;
generic: LIFE (':' LIFE ('+' LIFE)*)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' expr_simple)? ;
expr_simple: NUM | '{' stmts '}' | 'true' | 'false' | '-' NUM ;
bounds: bound ('+' bound)* '+'? ;
bound: LIFE | '?'? for? path | '(' '?'? for? path ')' ;
for: 'for' generics ;
where: 'where' (wherep (',' wherep)* ','?)? ;
wherep: LIFE ':' bounds | for? type ':' bounds? ;
struct: 'struct' ID generics? (where? '{' fields '}' | '(' (tfield (',' tfield)* ','?)? ')' where? ';' | where? ';') ;
fields: (field (',' field)* ','?)? ;
field: attr* vis? ID ':' type ;
tfield: attr* vis? type ;
enum: 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant: attr* vis? ID ('{' fields '}' | '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)? ;
impl: 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' inner* item* '}' ;
trait: 'unsafe'? 'trait' ID generics? (':' bounds?)? where? '{' item* '}' ;
type: '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '(' (type (',' type)* ','?)? ')' | '[' type (';' expr)? ']' | '!' | '_' | 'impl' bounds | 'dyn' bounds | for? ('unsafe' | 'extern' STR?)* 'fn' '(' (fnty (',' fnty)* ','?)? ')' ('->' type)? | path | '<' type ('as' path)? '>' '::' path | ID '!' tree ;
fnty: (ID ':')? type ;
path: '::'? seg ('::' seg)* ;
seg: (ID | 'self' | 'super' | 'crate' | 'Self') ('::'? typeargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
typeargs: '<' (typearg (',' typearg)* ','?)? '>' ;
typearg: LIFE | type | ID '=' type | ID ':' bounds | expr_simple | STR ;
epath: '::'? eseg ('::' (eseg | typeargs))* ;
eseg: ID | 'self' | 'super' | 'crate' | 'Self' ;
block: '{' inner* stmts '}' ;
stmts: stmt* expr? ;
stmt: ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* blocklike | attr* expr ';' | attr* epath '!' '{' tts '}' ;
pattern: '|'? pat1 ('|' pat1)* ;
pat1: pat0 (('..=' | '..' | '...') pat0?)? | ('..=' | '..') pat0? ;
pat0: '_' | '-'? NUM | STR | CHAR | 'true' | 'false' | ('ref')? 'mut'? ID ('@' pat1)? | '&' 'mut'? pat0 | '&&' 'mut'? pat0 | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']'
    | epath ('(' (pattern (',' pattern)* ','?)? ')' | '{' (fieldpat (',' fieldpat)* ','?)? '}')? | epath '!' tree ;
fieldpat: '..' | attr* ('ref')? 'mut'? ID (':' pattern)? | NUM ':' pattern ;
blocklike: (LIFE ':')? ('if' cond block ('else' (block | blocklike_if))? | 'match' hexpr '{' arm* '}' | 'while' cond block | 'loop' block | 'for' pattern 'in' hexpr block | 'unsafe' block | block) suffix* ;
blocklike_if: 'if' cond block ('else' (block | blocklike_if))? ;
cond: ('let' pattern '=')? hexpr ('&&' 'let' pattern '=' hexpr)* ;
arm: attr* pattern ('if' cond)? '=>' (blocklike ','? | expr ','?) ;
expr: unary (binop unary | 'as' type | ('..' | '..=') unary?)* | ('..' | '..=') unary? | closure | jump ;
hexpr: hunary (binop hunary | 'as' type | ('..' | '..=') hunary?)* | ('..' | '..=') hunary? | closure ;
jump: 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? ;
closure: 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr) ;
cparam: pat1 (':' type)? ;
binop: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
unary: ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'?)* (primary suffix* | jump | closure) ;
hunary: ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'?)* (hprimary suffix* | jump | closure) ;
primary: hprimary | epath '{' (sfield (',' sfield)* ','?)? '}' ;
sfield: '..' expr? | attr* (ID | NUM) (':' expr)? ;
hprimary: NUM | STR | CHAR | 'true' | 'false' | epath ('!' tree)? | '<' type ('as' path)? '>' '::' epath | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']' | blocklike | 'async' 'move'? block ;
suffix: '.' (ID ('::' typeargs)? | NUM | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | '?' ;
"""

_TEXT = {"python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "csharp": CSHARP, "rust": RUST}


def _with_keywords(language: str, text: str) -> str:
    """KEYWORD and ANY stand for every reserved word and every token."""
    from strataq.llm.lexers import _OPERATORS, KEYWORDS

    words = " | ".join(f"'{w}'" for w in KEYWORDS[language].split())
    operators = " | ".join(f"'{o}'" for o in _OPERATORS[language].split() if o not in "()[]{}")
    text = text.replace("KEYWORD", f"({words})")
    return text.replace("tt: tree | ANY", f"tt: tree | ID | NUM | STR | CHAR | LIFE | {words} | {operators}").replace("'_'", "UNDERSCORE")


@cache
def grammar(language: str) -> Grammar:
    return Grammar(_with_keywords(language, _TEXT[language]), "file")
