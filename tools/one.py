"""Show one query's result or its full error and plan: python tools/one.py name [sf]"""

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factloom.plans import REGISTRY  # noqa: E402
from factloom.session import local_session  # noqa: E402

spark = local_session()
df = REGISTRY[sys.argv[1]].run(spark, f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}")
df.explain("formatted")
try:
    print(df.toPandas().head(20).to_string())
except Exception:
    print(traceback.format_exc()[-6000:])
