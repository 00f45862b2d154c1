"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import op7_ngram_lm as _op7
from . import op8_substring as _op8
from . import op10_winnow as _op10
from .op1_secrets import op1_secrets
from .op2_packing import op2_packing
from .op3_tokenfile import op3_tokenfile
from .op4_simhash import op4_simhash
from .op5_quality import op5_quality
from .op6_media import op6_media
from .op9_langid import op9_langid

QUERIES = {q.__name__: q for q in (op1_secrets, op2_packing, op3_tokenfile, op4_simhash, op5_quality, op6_media, _op7.op7_ngram_lm, _op8.op8_substring, op9_langid, _op10.op10_winnow)}
ORACLES = {"op7_ngram_lm": _op7.SQL, "op8_substring": _op8.SQL, "op10_winnow": _op10.SQL}
