"""A small catalogue of our own that exercises the whole pipeline."""

TEXT = r"""~V||FIEBDC-3/2020\010125|demo|
~K|0\3\3\4\2\2\2\2\|
~C|ROOT##||DEMO||||
~C|G#||GARDEN||||
~C|GPA#||PATHS||||
~C|GPA100$|m|GRAVEL PATH||||
~C|GPA200$|m|KERB||||
~C|LB01|h|LABOURER|20.35||1|
~C|MT01|m3|GRAVEL|31.40||3|
~C|CP01|m3|BASE LAYER|||EA|
~C|%OVH|%|Overheads|||%|
~D|ROOT##|G#\\\|
~D|G#|GPA#\\\|
~D|GPA#|GPA100$\\\GPA200$\\\|
~D|CP01|LB01\\0.2500\MT01\\1.1000\|
~P|GPA100$|\WIDTH\ 1 \ 2 \
\SHIFT\Day\Night\
$E="No night work at width 2"
%E=%A=b & %B=b
%W(2)=0.12,0.25
$S(2)="D","N"
LB01 : 0.3333*(%B=a) + 0.5*(%B=b)
CP01 : %W(%A)
%%OVH : 0.06
\RESUMEN\Path $A m ($S(%B))\
\TEXTO\Gravel path of width $A m.
Shift: $B\|
~P|GPA200$|\STONE\granite\lime\sand\
\FINISH\saw\rough\
%P(3,2)=1.5,1,1.25,0.75,0.5,0.25
$T="sawn "*(%B=a)+"rough "*(%B=b)+$A
MT01 : ROUND(%P(%A,%B)/3,2)
LB%A%B : SQRT(%A-2)
MO07 : ABS(SIN(30)*%A)-0.5*(%A=a)
::10*%A^2-%P(%A,%B)
\RESUMEN\Kerb of $T %A%B\|
"""
