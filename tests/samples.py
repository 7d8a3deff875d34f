"""Sources that the tests chunk."""

MARKDOWN = "intro words\n\n# Guide\nabout it\n\n## Setup\nrun it\n```\n# not fenced off\n```\n## Use\n---\n### Flags\n-v\n\n# End\nlast\n"
_PYTHON = '''"""Jobs."""

LIMIT = 3


class Job:
    """One job."""

    tries: int = 0

    # when to try again
    def delay(self):
        return self.tries * 2


@traced
def submit(job):
    def inner():
        return job
    return inner()


if LIMIT:
    submit(Job())
'''
_JAVA = """package demo;

/** Makes reports. */
public class Reports {
    private final Store store;

    Reports(Store store) {
        this.store = store;
    }

    /** Where it is. */
    public List<String> where(String id) {
        return store.find(id);
    }

    enum Kind { DAILY, WEEKLY }
}
"""
SOURCES = {"corpus/demo/jobs.py": _PYTHON, "corpus/demo/Reports.java": _JAVA}
