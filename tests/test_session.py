"""The shared folder in sessions with and without a checkpoint setting, in processes of their own."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def in_own_session(tmp_path, code, setting=""):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "spark-defaults.conf").write_text(setting)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": ROOT, "BENCH_DRIVER_MEMORY": "1g"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


CODE = """
    import os
    from terrametra.session import build_session, durable, free, shared_folder, written
    spark = build_session("own", "2", 2)
    print(shared_folder(spark), spark.conf.get("spark.checkpoint.dir", None))
    assert durable(spark.range(10)).count() == 10
    df, path = written(spark.range(7), "seven")
    assert df.count() == 7 and path.startswith(shared_folder(spark))
    free(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
"""


def test_without_a_checkpoint_folder(tmp_path):
    out = in_own_session(tmp_path, CODE)
    assert "spark-warehouse/work None" in out


def test_with_a_checkpoint_folder(tmp_path):
    out = in_own_session(tmp_path, CODE, f"spark.checkpoint.dir file:{tmp_path}/shared\n")
    assert f"file:{tmp_path}/shared" in out
