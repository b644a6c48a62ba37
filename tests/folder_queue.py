"""A queue client for tests: messages are files of a folder, taken by renaming and deleted when acknowledged."""

import os
import uuid

from rillstone.sources.network import Client


class Folder(Client):
    def open(self):
        self.box, self.taken = self.options["box"], []
        os.makedirs(self.box, exist_ok=True)

    def poll(self):
        for name in sorted(os.listdir(self.box)):
            if name.endswith(".msg"):
                path = os.path.join(self.box, name)
                os.rename(path, path + ".taken")
                self.taken.append(path + ".taken")
                with open(path + ".taken", "rb") as f:
                    return f.read()
        return None

    def ack(self, n):
        for path in self.taken[:n]:
            os.remove(path)
        del self.taken[:n]

    def send(self, message):
        path = os.path.join(self.box, uuid.uuid4().hex)
        with open(path, "wb") as f:
            f.write(message)
        os.rename(path, path + ".msg")
